"""Sharding by proportional stratified interleaving (operator 12).

Within each source, rows are ranked in an order shuffled by a seed. The rank becomes a fraction,
(2 rank - 1) / (2 rows of the source), by which all rows are sorted; that interleaves the sources in
proportion. Cut into equal numbers of rows, every shard has the sources in the mixture of the whole
table, up to rounding.

Texts are read once, for their size and CRC-32; what is sorted is a small row for each document. A
source may hold any share of the rows: ranks and places are local row numbers in sorted ranges plus
the offsets of those ranges, so no task sees a whole source or table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._common import written

#: Bytes that a document takes besides its text.
OVERHEAD = 16
LAW = "rows"


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with part and at: the sorted range that a row lies in, and its place there. Written, since
    ranges are drawn from a sample: later steps must see the same ones."""
    place = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(place.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "sharding")


def interleaved(rows: DataFrame, stratum: Column, shuffle: Column) -> DataFrame:
    """rows with pos, their place from 0 in the interleaved order, and fraction. Rows of a stratum come
    in the order of shuffle; those that are equal in it, in any."""
    # Strata are told apart by text; null is one of its own.
    named = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))).withColumn("shuffle", shuffle)
    placed = _placed(named, ["stratum", "shuffle"])
    # A row for each stratum in each range: strata plus ranges at most, and ranges for one stratum.
    counts = placed.groupBy("stratum", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    parts = Window.partitionBy("stratum")
    before = F.sum("n").over(parts.orderBy("part")) - F.col("n")
    total = F.sum("n").over(parts)
    offsets = counts.select("stratum", "part", (before - F.col("first")).alias("offset"), total.alias("rows_of"))
    ranked = placed.join(offsets, ["stratum", "part"]).withColumn("fraction", (2 * (F.col("offset") + F.col("at")) + 1) / (2 * F.col("rows_of")))
    # Ties between sources are broken by the shuffle's order, too.
    sorted_ = _placed(ranked.drop("at", "part", "offset", "rows_of"), ["fraction", "shuffle", "stratum"])
    starts = _starts(sorted_)
    return sorted_.join(F.broadcast(starts), "part").withColumn("pos", F.col("start") + F.col("at")).drop("part", "at", "start", "stratum", "shuffle")


def _starts(placed: DataFrame) -> DataFrame:
    """(part, start) for each range: as many rows as there are partitions, summed on the driver."""
    rows, total = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):
        rows.append((part, total))
        total += n
    return placed.sparkSession.createDataFrame(rows, "part bigint, start bigint")


def cut(places: DataFrame, shards: int) -> DataFrame:
    """places with shard and slot: equal numbers of rows in a shard, at most one apart."""
    total = places.count()
    shard = F.expr(f"(pos * {shards}) div {max(1, total)}")
    # The first place of a shard is its number times rows over shards, rounded up.
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return places.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("pos") - first)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, source) for each row.

    size: UTF-8 bytes of the text plus 16. The law is `rows`: shards' numbers of rows are at most one
    apart, so no key decides and grown_shard is null. Null text has no bytes, null sources are a
    source of their own, null ids are shuffled like others. Rows that are equal in id, size and CRC-32
    are in any order among themselves. Other columns are not read. An empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.col(source_col).alias("source"))
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "text_crc32"))
    placed = cut(interleaved(light, F.col("source"), shuffle), shards)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("source").alias(source_col))


def mixture(sharded: DataFrame, source_col: str = "source") -> DataFrame:
    """(shard, source, n): the number of rows of each source in each shard."""
    return sharded.groupBy("shard", source_col).agg(F.count("*").alias("n"))
