"""Labelled rows: positional splits, and measures of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ["treino", "validação", "teste"]


def numbered(rows: DataFrame, order: list[str], name: str = "i", buckets: int = 64) -> DataFrame:
    """rows with a gapless number from 0 in the given order, nulls last; equal rows in any order.

    Spark draws ranges of the order from a sample, another one each time. So they are drawn once, for
    the lowest key and the number of rows of each; by these keys, which are fixed then, rows are dealt
    and numbered. Equal keys never lie in two ranges, so the numbers don't depend on the sample. The
    driver gets a row for each range, and no single task sees all rows. Reading rows again must give
    the same rows.
    """
    key = F.struct(*[x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{k}"), F.col(c).alias(f"v{k}"))])
    by = [F.col(c).asc_nulls_last() for c in order]
    drawn = rows.select(*order).repartitionByRange(buckets, *by).groupBy(F.spark_partition_id()).agg(F.min(key).alias("low"), F.count("*").alias("n"))
    found = drawn.select("low", "n").toArrow()  # a row for each range
    ranges = rows.sparkSession.createDataFrame(found, drawn.select("low", "n").schema)
    low = Window.orderBy("low")
    starts = ranges.select(F.col("low").alias("_low"), F.lead("low").over(low).alias("_next"), (F.sum("n").over(low) - F.col("n")).alias("_start"))
    keyed = rows.withColumn("_key", key)
    dealt = keyed.join(F.broadcast(starts), (F.col("_low") <= F.col("_key")) & (F.col("_next").isNull() | (F.col("_key") < F.col("_next")))).drop("_key", "_low", "_next")
    at = F.row_number().over(Window.partitionBy("_start").orderBy(*by)) - 1
    return dealt.withColumn(name, F.col("_start") + at).drop("_start")


def split_by_position(rows: DataFrame, position: str = "i") -> DataFrame:
    """rows with conjunto: of every 20 rows 3 test, 3 validation, 14 training."""
    r = F.col(position) % 20
    return rows.withColumn("conjunto", F.when(r < 3, SPLITS[2]).when(r < 6, SPLITS[1]).otherwise(SPLITS[0]))


def batches(rows: DataFrame, order: list[str], size: int = 32, seed: int | None = None) -> DataFrame:
    """rows with lote and lugar: batches of so many and places in them, from 0. With a seed the order
    is shuffled: by a hash of what the rows are ordered by, over all rows and not in a buffer, so
    that it is the same for the same seed on any cluster."""
    if seed is None:
        placed = numbered(rows, order, "_i")
    else:
        placed = numbered(rows.withColumn("_shuffled", F.xxhash64(*order, F.lit(seed))), ["_shuffled", *order], "_i").drop("_shuffled")
    return placed.withColumn("lote", F.floor(F.col("_i") / size)).withColumn("lugar", F.col("_i") % size).drop("_i")


def split_crosstab(rows: DataFrame, label: str = "classe") -> DataFrame:
    """One row for each class: rows in each split, their total and the share of training."""
    counts = [F.count_if(F.col("conjunto") == s).alias(n) for s, n in zip(SPLITS, ["treino", "validacao", "teste"], strict=True)]
    return rows.groupBy(label).agg(*counts, F.count("*").alias("total"), F.round(100 * F.count_if(F.col("conjunto") == SPLITS[0]) / F.count("*"), 1).alias("pct_treino"))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("acuracia"))


def class_report(rows: DataFrame) -> DataFrame:
    """(classe, precisao, revocacao, f1, suporte) for each class that occurs, then macro and
    weighted averages. Undefined ratios are 0."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("pred") == F.col("truth")).cast("int").alias("tp")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("s")).select("s.*")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    sums = sides.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    each = sums.select(F.col("c").cast("string").alias("classe"), ratio(F.col("tp"), F.col("p")).alias("precisao"), ratio(F.col("tp"), F.col("t")).alias("revocacao"), ratio(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"), F.col("t").alias("suporte"))
    measures = ["precisao", "revocacao", "f1"]
    macro = each.agg(F.lit("macro avg").alias("classe"), *[F.avg(m).alias(m) for m in measures], F.sum("suporte").alias("suporte"))
    weighted = each.agg(F.lit("weighted avg").alias("classe"), *[(F.sum(F.col(m) * F.col("suporte")) / F.sum("suporte")).alias(m) for m in measures], F.sum("suporte").alias("suporte"))
    return each.unionByName(macro).unionByName(weighted)


def confusion(rows: DataFrame, classes: int) -> DataFrame:
    """(truth, pred, fracao) for the whole grid of classes; each true class's row sums to 1 or 0."""
    spark = rows.sparkSession
    grid = spark.range(classes * classes).select((F.col("id") / classes).cast("int").alias("truth"), (F.col("id") % classes).cast("int").alias("pred"))
    found = rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("truth"))
    return grid.join(found, ["truth", "pred"], "left").select("truth", "pred", F.coalesce(share, F.lit(0.0)).alias("fracao"))


def confidence_by_outcome(rows: DataFrame) -> DataFrame:
    right = F.col("pred") == F.col("truth")
    return rows.agg(F.avg(F.when(right, F.col("conf"))).alias("media_acertos"), F.avg(F.when(~right, F.col("conf"))).alias("media_erros"))


def threshold_coverage(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: right answers rejected (and their share of all rows), errors blocked."""
    right = F.col("pred") == F.col("truth")
    found = []
    for t in thresholds:  # all in one scan
        lost = right & (F.col("conf") < t)
        found.append(F.struct(F.lit(t).alias("limiar"), F.count_if(lost).alias("acertos_rejeitados"), F.avg(lost.cast("double")).alias("fracao_rejeitada"), F.count_if(~right & (F.col("conf") < t)).alias("erros_bloqueados")))
    return rows.agg(F.array(*found).alias("found")).select(F.explode("found").alias("f")).select("f.*")


def split_sizes(rows: DataFrame) -> DataFrame:
    """One row: how many rows each split has."""
    return rows.agg(*[F.count_if(F.col("conjunto") == s).alias(n) for s, n in zip(SPLITS, ["treino", "validacao", "teste"], strict=True)])


def metrics(rows: DataFrame, training_rows: int, threshold: float) -> dict:
    """The measures of a test set as one document: accuracy, sizes, and the report by class with the
    overall accuracy and the averages. The driver gets a row for each class."""
    names = {"precisao": "precision", "revocacao": "recall", "f1": "f1-score", "suporte": "support"}
    report = {r.classe: {names[c]: r[c] for c in names} for r in class_report(rows).collect()}
    total, right = rows.agg(F.count("*"), F.avg((F.col("pred") == F.col("truth")).cast("double"))).first()
    averages = {k: report.pop(k) for k in ("macro avg", "weighted avg")}
    by_class = dict(sorted(report.items(), key=lambda x: (len(x[0]), x[0])))
    return {"acuracia_teste": right, "imagens_teste": total, "imagens_treino": training_rows, "limiar_confianca": threshold, "por_classe": {**by_class, "accuracy": right, **averages}}


def joined_histories(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two training phases' histories (metrica, valores array) as one: the second's values go on
    after the first's; a measure that one phase lacks keeps the other's."""
    b = second.select("metrica", F.col("valores").alias("_more"))
    none = F.array().cast(second.schema["valores"].dataType)
    return first.join(b, "metrica", "full").select("metrica", F.concat(F.coalesce("valores", none), F.coalesce("_more", none)).alias("valores"))
