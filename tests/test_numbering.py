"""Places, batches and splits over so many rows that ranges are drawn from a sample of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.operators import evaluate
from folio.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """60,000 documents out of order, some without an id or a language."""
    folder = tmp_path_factory.mktemp("many")
    d = spark.range(0, 60_000, 1, 8).select(F.col("id") * 7919 % 60_000, (F.col("id") % 5).alias("k")).toDF("doc_id", "k")
    lang = F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr"])), (F.col("k") + 1).cast("int"))
    d = d.select(F.when(F.col("doc_id") % 9973 != 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("k") < 4, lang).alias("lang"))
    d.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["loader_batches", "split_assign", "split_crosstab", "split_sizes"])
def test_many_documents(spark, documents, name):
    folder, con = documents
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_sizes_of_all_documents(spark, documents):
    """Every document is in a split, also those in Spanish and those without a language."""
    folder, _ = documents
    assert QUERIES["split_sizes"](spark, folder).first().asDict() == {"treino": 42_000, "validacao": 9_000, "teste": 9_000}


def test_orders_of_several_kinds(spark):
    d = spark.range(0, 50_000, 1, 4).select("id", F.timestamp_micros((F.floor(F.col("id") * 31 % 50_000 / 4) + 1_729_990_000) * 1_000_000).alias("t"), F.concat(F.lit("é"), (F.col("id") % 7).cast("string")).alias("s"), F.when(F.col("id") % 4 == 1, float("nan")).when(F.col("id") % 4 != 2, F.col("id") / 3).alias("x"))
    got = evaluate.numbered(d, ["t", "s", "x"])
    assert got.columns == ["id", "t", "s", "x", "i"]
    found = sorted(got.select("i", F.unix_micros("t").alias("t"), "s", "x").collect())
    assert [r.i for r in found] == list(range(50_000))
    places = [(r.t, r.s, r.x is None, r.x is not None and r.x != r.x, 0 if r.x is None or r.x != r.x else r.x) for r in found]
    assert places == sorted(places)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(None, 1)], "k string, _n int")
    assert [tuple(r) for r in evaluate.numbered(one, ["k"]).collect()] == [(None, 1, 0)]
    none = evaluate.numbered(one.filter("_n > 1"), ["k"])
    assert none.collect() == [] and none.schema["i"].dataType.typeName() == "long"
    same = evaluate.numbered(spark.range(0, 30, 1, 3).select(F.lit("a").alias("k")), ["k"])
    assert sorted(r.i for r in same.collect()) == list(range(30))
