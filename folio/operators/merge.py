"""Two engines over one batch: four modes, and what happens when an engine is out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from folio import domain as D

# The modes by their names.
AUTO, ONLY_CNN, ONLY_VLM, COMPARE = "Automático (CNN → VLM)", "Somente CNN especializado", "Somente visão generalista", "Comparar os dois motores"
MODES = {"auto": AUTO, "cnn": ONLY_CNN, "vlm": ONLY_VLM, "comparacao": COMPARE, "comparar": COMPARE}


class EngineUnavailable(RuntimeError):
    """An engine that the mode can't do without."""


def last_of_name(results: DataFrame, key: str = "arquivo") -> DataFrame:
    """One record for each name: of repeated names the last one's. (key="pos" keeps all apart.)"""
    fields = [c for c in results.columns if c != key]
    packed = results.groupBy(key).agg(F.max_by(F.struct(*fields), F.col("pos")).alias("r"))
    return packed.select(key, F.col("r"))


def vlm_targets(items: DataFrame, cnn: DataFrame) -> DataFrame:
    """Items that the CNN has no answer to, or an undetermined one; to be asked before the second
    engine runs."""
    sure = last_of_name(cnn).filter(F.col("r.condicao") != D.UNDETERMINED)
    return items.join(sure.select("arquivo"), "arquivo", "left_anti")


def merge(items: DataFrame, cnn: DataFrame, vlm: DataFrame, mode: str = AUTO, dropped: Observation | None = None) -> DataFrame:
    """(pos, ordem, record) in the order of items(pos, arquivo). dropped observes, as descartados, how
    many items had no record, when the result is first computed.

    Records are found by name, so items of one name all get its last record. Items without a
    record are left out. In comparison the CNN's record comes first (ordem 0), then the other (1).
    """
    one, two = last_of_name(cnn).withColumnRenamed("r", "c"), last_of_name(vlm).withColumnRenamed("r", "v")
    base = items.select("pos", "arquivo")
    both = base
    both = both.join(one, "arquivo", "left") if mode != ONLY_VLM else both.withColumn("c", F.lit(None))
    both = both.join(two, "arquivo", "left") if mode != ONLY_CNN else both.withColumn("v", F.lit(None))
    if dropped is not None:
        both = both.observe(dropped, F.count_if(F.col("c").isNull() & F.col("v").isNull()).alias("descartados"))
    if mode == ONLY_CNN:
        found = both.select("pos", "arquivo", F.lit(0).alias("ordem"), F.col("c").alias("r"))
    elif mode == ONLY_VLM:
        found = both.select("pos", "arquivo", F.lit(1).alias("ordem"), F.col("v").alias("r"))
    elif mode == AUTO:
        found = both.select("pos", "arquivo", F.when(F.col("v").isNotNull(), 1).otherwise(0).alias("ordem"), F.coalesce("v", "c").alias("r"))
    elif mode == COMPARE:
        pair = F.array(F.struct(F.lit(0).alias("ordem"), F.col("c").alias("r")), F.struct(F.lit(1).alias("ordem"), F.col("v").alias("r")))
        found = both.select("pos", "arquivo", F.explode(pair).alias("e")).select("pos", "arquivo", "e.ordem", "e.r")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    found = found.filter("r IS NOT NULL")
    return found.select("pos", "ordem", "arquivo", *[F.col(f"r.{f}").alias(f) for f in D.RECORD.names if f != "arquivo"])


def analyse(items: DataFrame, run_cnn, run_vlm, mode: str = AUTO, dropped: Observation | None = None) -> tuple[DataFrame, list[str]]:
    """(records, warnings). run_cnn and run_vlm take items and return records, or raise
    EngineUnavailable.

    A missing CNN is fatal in its own mode and a warning elsewhere; a missing VLM is fatal unless
    there are CNN records. The CNN's records should be cheap to read twice (written or cached).
    """
    if mode not in MODES.values():
        raise ValueError(f"unknown mode {mode!r}")
    none = items.sparkSession.createDataFrame([], f"pos bigint, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in D.RECORD)}")
    if not items.head(1):
        return none.withColumn("ordem", F.lit(0)), []
    warnings, cnn, vlm = [], none, none
    have_cnn = False
    if mode != ONLY_VLM:
        try:
            cnn, have_cnn = run_cnn(items), True
        except EngineUnavailable as e:
            if mode == ONLY_CNN:
                raise
            warnings.append(f"CNN engine unavailable: {e}")
    if mode != ONLY_CNN:
        targets = vlm_targets(items, cnn) if mode == AUTO and have_cnn else items
        if targets.head(1):
            try:
                vlm = run_vlm(targets)
            except EngineUnavailable as e:
                if not have_cnn:
                    raise
                warnings.append(f"vision engine unavailable: {e}")
    return merge(items, cnn, vlm, mode, dropped), warnings


def group_by_file(records: DataFrame) -> DataFrame:
    """(arquivo, primeira, motores): the engines of each file in order, files by first appearance."""
    return records.groupBy("arquivo").agg(F.min("pos").alias("primeira"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ordem", "motor"))), lambda x: x["motor"]), ",").alias("motores"))


def summary(records: DataFrame) -> DataFrame:
    """One row: totals, distinct files, and a count for each condition and engine (zeros too)."""
    counts = [F.count_if(F.col("condicao") == c).alias(n) for c, n in zip(D.CONDITIONS, ["saudaveis", "doentes", "indeterminados"], strict=True)]
    engines = [F.count_if(F.col("motor") == m).alias(n) for m, n in ((D.CNN, "do_cnn"), (D.VLM, "do_vlm"))]
    return records.agg(F.count("*").alias("total_laudos"), F.countDistinct("arquivo").alias("total_imagens"), *counts, *engines)


def batch_signature(items: DataFrame, keys: list[str], mode: str, threshold: float, name: str = "n_name", size: str = "n") -> DataFrame:
    """(keys, assinatura): names and sizes of all items of each batch in order of the name, its mode and
    its threshold as one text, by which a change of the batch is told. Items without a name or size
    are left out; a batch of no others has none. One task puts a batch's text together."""
    pair = F.concat(F.col(name), F.lit(":"), F.col(size).cast("string"))
    packed = items.select(*keys, F.col(name).alias("_name"), F.col(size).alias("_size"), pair.alias("_pair"))
    joined = F.expr("listagg(_pair, '|') WITHIN GROUP (ORDER BY _name, _size)")
    return packed.groupBy(*keys).agg(F.concat(joined, F.lit(f"|{mode}|{threshold}")).alias("assinatura"))


def in_rows_of(items: DataFrame, batch: str, order: str, width: int = 3) -> DataFrame:
    """items with linha: the row of a page that holds so many side by side, from 0 in each batch."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return items.withColumn("linha", F.floor((place - 1) / width).cast("int"))


def display_order(records: DataFrame) -> DataFrame:
    """records with lugar: the place when the CNN's come first, else as before; within a file."""
    w = Window.partitionBy("arquivo").orderBy(F.col("motor") != D.CNN, "pos", "ordem")
    return records.withColumn("lugar", F.row_number().over(w))
