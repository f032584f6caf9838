"""Matching free label names to classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio import domain as D
from folio.functions.text import normalise


def _matches(labels: DataFrame, column: str) -> DataFrame:
    """labels and _hits: indexes of the classes whose patterns the name holds, all of them. Twelve
    literal predicates on a row take the place of a join of every row with the catalogue."""
    name = normalise(F.col(column))
    hits = []
    for i, (_, patterns, *_) in enumerate(D.CATALOGUE):
        every = F.lit(True)
        for p in patterns:
            every &= F.contains(name, F.lit(p))
        hits.append(F.when(every, F.lit(i)))
    return labels.withColumn("_hits", F.filter(F.array(*hits), lambda x: x.isNotNull()))


def match_labels(labels: DataFrame, column: str, on_ambiguous: str = "first") -> DataFrame:
    """labels with idx and id_classe, null where no class matches. Where several match, the first
    of the catalogue, or with on_ambiguous="error" an error."""
    found = _matches(labels, column)
    if on_ambiguous == "error" and (bad := found.filter(F.size("_hits") > 1).select(column).first()):
        raise ValueError(f"label {bad[0]!r} matches more than one class")
    ids = F.array(*[F.lit(c[0]) for c in D.CATALOGUE])
    idx = F.try_element_at("_hits", F.lit(1))
    return found.withColumn("idx", idx).withColumn("id_classe", F.when(idx.isNotNull(), F.element_at(ids, idx + 1))).drop("_hits")


def kept_labels(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose label is that of a class of the catalogue, with idx and id_classe. Labels are
    matched once for each distinct name; there are as many as the dataset has classes."""
    names = match_labels(rows.select(F.col(column)).distinct(), column).filter("idx IS NOT NULL")
    return rows.join(names, column)


def check_label_map(labels: DataFrame, column: str) -> None:
    """An error unless the distinct names match all classes, each just once."""
    found = match_labels(labels.select(F.col(column)).distinct(), column).filter("idx IS NOT NULL")
    counts = dict(found.groupBy("idx").count().collect())  # a row for each class
    if len(counts) != len(D.CATALOGUE):
        raise ValueError(f"labels match {len(counts)} of {len(D.CATALOGUE)} classes")
    if twice := sorted(i for i, n in counts.items() if n > 1):
        raise ValueError(f"several labels match the classes {twice}")


def remapped(label: Column, mapping: dict[int, int], dropped: int = -1) -> Column:
    """A label's index in a map, or the mark of dropped ones."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), label), F.lit(dropped))


def ambiguous_labels(labels: DataFrame, column: str) -> DataFrame:
    """(label, n): the distinct names that match more than one class."""
    return _matches(labels.select(F.col(column)).distinct(), column).filter(F.size("_hits") > 1).select(column, F.size("_hits").alias("n"))
