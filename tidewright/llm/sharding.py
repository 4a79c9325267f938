"""Sharding by sampled splitters: ranges of a key, cut at size-weighted quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a range, each of which is one window sort; the least and the most ranges there are.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 2_000_000, 256, 16_384
#: Keys drawn for each range: splitters come from a size-weighted sample of about so many keys.
DRAWS = 32


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Cuts that are at most the key, found in two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    fan = max(16, math.isqrt(len(cuts)))
    rows = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    table_ = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    row = F.size(F.filter(heads, lambda c: c <= key))
    within = F.size(F.filter(F.get(table_, row - 1), lambda c: c <= key))
    return F.when(row == 0, F.lit(0)).otherwise((row - 1) * fan + within)


def shard(rows: DataFrame, n_shards: int, size: str, key: str, tie: str) -> DataFrame:
    """Add `shard` (0..n-1) and `slot` (gapless from 0) so that the shards' sizes are near equal.

    rows: slim rows (no payload) with a long `size` above 0 and a long `key`. Keys are drawn
    with a probability in proportion to size (by a hash of `tie`, so a repeated task draws the
    same) and their quantiles cut the key line into ranges. A key as heavy as a range has one of
    its own, cut on both sides. A range over twice its share is subdivided: one key's by a hash
    of `tie`, one of several keys by a hash of the key, so rows of a key stay together. Rows are
    laid out in the order of range, part, key and tie; a row goes to the shard in which its first
    byte falls, so a shard is off its share by one row at most, and rows of one key lie next to
    each other and part only where a shard ends. Null ties go first; repeated rows are rows of
    their own; an empty table gives no rows.
    """
    rows = materialize(rows, "shard-keys")
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranges = min(max(LEAST_RANGES, n // RANGE_ROWS), MOST_RANGES)
    sample = DRAWS * ranges
    spread = F.pmod(F.xxhash64(F.lit("draw"), F.col(key), F.col(tie)), F.lit(1 << 52)) / float(1 << 52)
    weight = F.col(size) * (sample / total)
    drawn = (
        rows.select(F.col(key).alias("k"), (F.floor(weight).cast("long") + (spread < weight - F.floor(weight)).cast("long")).alias("n"))
        .where("n > 0")
        .groupBy("k")
        .agg(F.sum("n").alias("n"))
        .orderBy("k")
        .collect()  # about `sample` keys
    )
    marks: set[int] = set()
    alone: set[int] = set()
    seen, step = 0, max(1, sum(r.n for r in drawn) / ranges)
    for r in drawn:
        if r.n >= step:
            marks |= {r.k, r.k + 1}
            alone.add(r.k)
        elif seen // step != (seen + r.n) // step:
            marks.add(r.k)
        seen += r.n
    cuts = sorted(x for x in marks if x < 1 << 63)
    placed = rows.withColumn("_r", _range_of(F.col(key), cuts))
    share = total / (len(cuts) + 1)
    full = placed.groupBy("_r").agg(F.sum(size).alias("b")).where(F.col("b") > 2 * share).collect()  # fewer than `ranges` rows
    one_key = {i + 1 for i, c in enumerate(cuts) if c in alone}
    parts = F.lit(1)
    if full:
        into = F.create_map(*[F.lit(x) for r in full for x in (r["_r"], int(r["b"] / share) + 1)])
        parts = F.coalesce(F.try_element_at(into, F.col("_r")), F.lit(1))
    single = F.col("_r").isin(*one_key) if one_key else F.lit(False)
    by = F.when(single, F.xxhash64(F.lit("part"), F.col(tie))).otherwise(F.xxhash64(F.lit("part"), F.col(key)))
    placed = placed.withColumn("_p", F.pmod(by, parts).cast("int"))
    before = Window.orderBy("_r", "_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        placed.groupBy("_r", "_p")
        .agg(F.sum(size).alias("b"), F.count("*").alias("c"))
        .select("_r", "_p", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c0"))
    )
    inside = Window.partitionBy("_r", "_p").orderBy(key, tie, size)
    laid = placed.withColumns(
        {
            "_b": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size),
            "_c": F.row_number().over(inside) - 1,
        }
    ).join(F.broadcast(sums), ["_r", "_p"])  # a few times `ranges` rows
    laid = laid.withColumn("shard", F.floor((F.col("_b0") + F.col("_b")).cast("decimal(38,0)") * n_shards / F.lit(total)).cast("int")).withColumn("_c", F.col("_c0") + F.col("_c"))
    laid = materialize(laid.drop("_r", "_p", "_b0", "_c0", "_b"), "shard-laid")
    first = laid.groupBy("shard").agg(F.min("_c").alias("_first"))
    return laid.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_c") - F.col("_first")).cast("long")).drop("_c", "_first")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 8 shards under the law `bytes`; equal texts lie next to each other and
    part only where a shard's border cuts their group."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_key"),
    )
    out = shard(docs, 8, "size", "_key", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
