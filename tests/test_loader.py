"""The shuffle buffer's rule, prefetching, batches."""

import random
import threading
import time

import pytest

from folio.operators import loader


def plain(rows, buffer, seed):
    """The rule by lists: draw a place of what is held, hand it out, put the next in its place."""
    luck, held, rest, out = random.Random(seed), list(rows)[:buffer], list(rows)[buffer:], []
    while held:
        at = luck.randrange(len(held))
        out.append(held[at])
        if rest:
            held[at] = rest.pop(0)
        else:
            held[at] = held[-1]
            held.pop()
    return out


@pytest.mark.parametrize("n, buffer", [(0, 4), (1, 4), (4, 4), (5, 4), (1000, 1), (1000, 64), (30, 100)])
def test_buffer(n, buffer):
    got = list(loader.shuffled(range(n), buffer, 7))
    assert got == plain(range(n), buffer, 7) == list(loader.shuffled(iter(range(n)), buffer, 7))
    assert sorted(got) == list(range(n)) and (n < 10 or buffer == 1 or got != list(loader.shuffled(range(n), buffer, 8)))
    assert all(x < i + buffer for i, x in enumerate(got))  # a row can't come before it was in the buffer


def test_no_more_is_held_than_the_buffer():
    taken = [0]

    def rows():
        for i in range(10_000):
            taken[0] = i
            yield i

    for i, _ in enumerate(loader.shuffled(rows(), 50, 1)):
        assert taken[0] <= i + 50


def test_prefetching():
    made = []

    def rows():
        for i in range(100):
            made.append(i)
            yield i

    it = loader.prefetched(rows(), 3)
    assert next(it) == 0
    time.sleep(0.3)
    assert len(made) <= 6  # one taken, three waiting, one in hand
    assert list(it) == list(range(1, 100))
    with pytest.raises(ZeroDivisionError):
        list(loader.prefetched(1 // (2 - i) for i in range(5)))
    before = threading.active_count()
    it = loader.prefetched(iter(range(10**9)), 2)
    next(it)
    it.close()
    time.sleep(0.4)
    assert threading.active_count() <= before


def test_batches_of_a_table(spark):
    d = spark.range(0, 1000, 1, 5)
    plain_order = [r.id for b in loader.batches(d) for r in b]
    assert plain_order == list(range(1000)) and [len(b) for b in loader.batches(d)] == [32] * 31 + [8]
    one = [[r.id for r in b] for b in loader.batches(d, 64, seed=5, buffer=100)]
    assert one == [[r.id for r in b] for b in loader.batches(d, 64, seed=5, buffer=100)]
    assert [i for b in one for i in b] == plain(range(1000), 100, 5)
    assert sum(loader.batches(d, make=lambda b: sum(r.id for r in b))) == 499_500


def test_batches_in_tasks(spark):
    d = spark.range(0, 1000, 1, 5)
    run = lambda seed: [tuple(r) for r in loader.in_tasks(d, lambda b: [{"n": len(b), "first": b[0]["id"]}], "n bigint, first bigint", 64, seed, 100).collect()]
    assert run(None)[:4] == [(64, 0), (64, 64), (64, 128), (8, 192)] and run(3) == run(3) != run(4) and sum(n for n, _ in run(3)) == 1000
