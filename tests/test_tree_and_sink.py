"""Files of a tree with hidden names, and one file written by many tasks."""

import os

import pytest
from pyspark.sql import functions as F

from folio import domain as D
from folio.sources import files, one_file, tree

NAMES = ["a.py", ".env", "_x.py", ".git/config", ".git/objects/ab/1", "web/app.JS", "web/node_modules/m/i.js", "d/e/f/g/h/i/j/k.txt", "_build/historico.db", "sem sufixo", "d/.hidden/..b", "é/ü.PY"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for n, name in enumerate(NAMES):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * n)
    (root / "empty").mkdir()
    os.symlink(root, root / "web/loop")
    return root


def plain(root, keep):
    return sorted(p for d, _, fs in os.walk(root) for p in (os.path.relpath(os.path.join(d, f), root) for f in fs) if keep(p))


def test_every_file_is_listed_and_leaks_are_found(spark, folder):
    found = files.all_files(spark, str(folder))
    assert sorted(r.caminho for r in found.collect()) == plain(folder, lambda p: True) == sorted(NAMES)
    assert {r.caminho: r.length for r in found.collect()} == {n: i for i, n in enumerate(NAMES)}
    assert sorted(r.caminho for r in files.leaks(found).collect()) == [".env", "_build/historico.db"]
    assert sorted(r.caminho for r in files.package_files(found).collect()) == sorted(set(NAMES) - {".env", ".git/config", ".git/objects/ab/1", "web/node_modules/m/i.js", "_build/historico.db"})
    pruned = files.package_files(files.all_files(spark, f"file://{folder}", D.EXCLUDED_DIRS))
    assert sorted(r.caminho for r in pruned.collect()) == sorted(r.caminho for r in files.package_files(found).collect())


@pytest.mark.parametrize(
    "condition, keep",
    [
        ("caminho LIKE 'web/%'", lambda p: p.startswith("web/")),
        ("caminho LIKE 'd/e/f/%' AND sufixo = '.txt'", lambda p: p.startswith("d/e/f/") and p.endswith(".txt")),
        ("sufixo IN ('.py', '.js')", lambda p: p.lower().endswith((".py", ".js"))),
        ("caminho NOT LIKE '.git/%' AND nome LIKE '%g'", lambda p: not p.startswith(".git/") and p.endswith("g")),
        ("nome = 'config' AND length > 2", lambda p: p == ".git/config"),
        ("caminho LIKE 'nowhere/%'", lambda p: False),
    ],
)
def test_filters_are_pushed_down_and_right(spark, folder, condition, keep):
    got = tree.file_tree(spark, str(folder)).filter(condition)
    assert sorted(r.caminho for r in got.collect()) == plain(folder, keep)


def test_subtrees_that_filters_rule_out_are_not_entered(folder, monkeypatch):
    entered = []
    real = tree._entries
    monkeypatch.setattr(tree, "_entries", lambda fs, f: (entered.append(os.path.relpath(f, folder)), real(fs, f))[1])
    reader = tree.TreeReader(str(folder), {"node_modules"})
    rest = list(reader.pushFilters([tree.StringStartsWith(("caminho",), "web/"), tree.Not(tree.StringStartsWith(("caminho",), ".git/")), tree.In(("sufixo",), (".js",)), tree.EqualTo(("length",), 3)]))
    rows = [r["caminho"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows == ["web/app.JS"] and set(entered) == {".", "web"} and len(rest) == 1
    assert tree.suffix_of("a.PY") == ".py" and tree.suffix_of(".env") == "" and tree.suffix_of("..b") == "" and tree.suffix_of("b") == ""


def test_many_subtrees_become_partitions(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("d"), F.col("id") % 90, F.lit("/.h/f"), "id").alias("caminho"), F.lit(1).alias("length"))
    assert tree.planted(rows, str(tmp_path)) == 300
    got = tree.file_tree(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 91 and got.distinct().count() == 300
    with pytest.raises(Exception, match="No such file"):
        tree.file_tree(spark, str(tmp_path / "none")).count()


@pytest.mark.parametrize("in_places", [True, False])
def test_one_file_in_the_order_of_rows(spark, tmp_path, in_places):
    lines = spark.range(0, 5000, 1, 9).select(F.concat(F.lit("é"), "id").alias("line"))
    target = tmp_path / "x.txt"
    target.write_text("old")
    for rows, n in ((lines, 5000), (lines.filter("id % 1000 = 999"), 5), (lines.filter("id < 0"), 0)):
        one_file.write_one_file(rows, f"file://{target}", "[", ", ", "]", in_places)
        expected = [i for i in range(5000) if n == 5000 or i % 1000 == 999 and n]
        assert target.read_text(encoding="utf-8") == "[" + ", ".join(f"é{i}" for i in expected) + "]"
    assert os.listdir(tmp_path) == ["x.txt"] and one_file.parts_left(str(tmp_path)) == []


def test_a_failed_task_leaves_nothing_and_keeps_the_old_file(spark, tmp_path):
    (tmp_path / "x.txt").write_text("old")
    lines = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("boom"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="boom"):
        one_file.write_one_file(lines, str(tmp_path / "x.txt"))
    assert os.listdir(tmp_path) == ["x.txt"] and (tmp_path / "x.txt").read_text() == "old"


def test_parts_of_lost_attempts_do_not_count(tmp_path):
    """What a killed attempt left in the folder of the parts is not in the list that the commit writes."""
    writer = one_file.PartsWriter(str(tmp_path / "p"), "")
    os.makedirs(tmp_path / "p")
    for name in ("part-000000-7", "part-000000-8", "part-000001-9"):
        (tmp_path / "p" / name).write_text(name)
    writer.commit([one_file.Part(1, "part-000001-9", 13), None, one_file.Part(0, "part-000000-8", 13), one_file.Part(2, "part-000002-10", 0)])
    assert (tmp_path / "p" / one_file.MANIFEST).read_text() == '[[0, "part-000000-8", 13], [1, "part-000001-9", 13]]'
    writer.abort([])
    assert not (tmp_path / "p").exists()
