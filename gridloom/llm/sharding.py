"""Shards that all have the corpus's mixture: proportional stratified interleaving.

Rows are ranked within their source in the order of a seeded hash. A row's
fractional rank ``(rank + 1/2) / rows of the source`` spreads each source evenly over
[0, 1); sorting all rows by it interleaves the sources in proportion, and cutting
that order into equal stretches gives shards of the same mixture whose row counts
differ by one at most (the law ``rows``).

Both rankings are distributed: the hash (or the fractional rank) is cut into ranges,
rows are numbered within a range, and a range's offset is the count of the rows in
the ranges before it. So a source with a third of all rows is spread over as many
tasks as any other rows, and no window runs over more than a range.

Defined results: rows with a null source form a source of their own; a null text has
size 16 and the CRC of the empty text; repeated rows are ranked one by one; an empty
table gives an empty result; of the input only id, source and text are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import documents, materialize, partitions

SHARDS, SEED = 40, 20240229
ROW_BYTES = 16
#: Rows that a range holds at most on average, when there are many rows.
RANGE_ROWS = 200_000


def stratified_shards(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``id, source, size, text_crc32, position, shard, slot`` for each row; no text is shuffled."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("__size"), F.crc32(text).alias("__crc"))
    rows = rows.withColumn("__hash", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__id", "__crc", "__size"), 1))
    rows = materialize(rows.withColumn("__key", F.xxhash64("__source")), "shard-rows")
    n = rows.count()
    ranges = max(4 * partitions(df.sparkSession), -(-n // range_rows))
    rows = rows.withColumn("__range", F.shiftright(F.shiftright("__hash", 32) * F.lit(ranges), 31))

    ties = ["__hash", "__id", "__crc", "__size"]
    counts = rows.groupBy("__key", "__range").agg(F.count("*").alias("__n"))
    before = W.partitionBy("__key").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__key", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy("__key")).alias("__of"))
    rank = F.col("__before") + F.row_number().over(W.partitionBy("__key", "__range").orderBy(*ties)) - 1
    ranked = rows.join(counts, ["__key", "__range"]).withColumn("__rank", rank)
    # Twice the fractional rank's numerator; a range of it by whole numbers only.
    ranked = ranked.withColumn("__odd", 2 * F.col("__rank") + 1).withColumn("__range", F.expr(f"CAST(__odd * {ranges} DIV (2 * __of) AS INT)"))
    ranked = materialize(ranked.select("__id", "__source", "__key", "__size", "__crc", "__hash", "__range", (F.col("__odd") / (2 * F.col("__of"))).alias("__fraction")), "shard-ranks")

    starts = ranked.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = starts.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(W.partitionBy("__range").orderBy("__fraction", "__key", *ties)) - 1
    placed = ranked.join(starts, "__range").withColumn("position", place)
    placed = placed.withColumn("shard", F.expr(f"CAST(position * {n_shards} DIV {max(n, 1)} AS INT)"))
    first = F.expr(f"(CAST(shard AS LONG) * {n} + {n_shards - 1}) DIV {n_shards}")
    return placed.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "position", "shard", (F.col("position") - first).alias("slot"))


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stratified_shards(documents(spark, sf_dir))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
