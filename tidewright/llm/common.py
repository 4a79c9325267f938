"""What the operators of this package share: tables, the shared folder and native text helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word in every contract of this package, as a Java class body and as characters.
BLANK = r" \t\n\x0B\f\r"
BLANK_CHARS = " \t\n\x0b\x0c\r"

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a folder of our own is taken, but in local mode only: on a cluster a
    folder of one machine would be invisible to the others, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts the lineage, survives lost
    executors, and makes what several readers see one and the same."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_forget, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession) -> None:
    """At the end of the session its intermediate tables go."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


#: Rows that Python gets at a time, where the session has Spark's default: texts are long.
ARROW_ROWS = 512


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches. Python workers are used again by later
    stages, so what a task has freed goes back to the system at its end."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))

    def trimmed(batches):
        yield from run(batches)
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return df.mapInArrow(trimmed, schema)


#: Bits of a filter of keys for each of them, and the most it may have (16 MB). A full filter lets
#: more pass, which costs shuffle but changes no result.
FILTER_RATIO, FILTER_BITS = 16, 1 << 27


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Bits (of the low bits) of a column of hashes, a power of two of them in number."""
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (FILTER_RATIO * n).bit_length()))
    slot = F.col(key).bitwiseAND(F.lit(bits - 1)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()  # at most FILTER_BITS bits
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        m = np.frombuffer(bytes(r.m), np.uint8)
        at = (r.b - 1) * len(m)
        out[at : at + len(m)] = m[: len(out) - at]
    return out


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What stands for a row in joins: its id and its text's hash, so null ids and ids that
    several texts share are told apart; rows alike in both are one document."""
    return [doc_id.alias("_id"), F.xxhash64(text).alias("_th")]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row; a plain reference would be computed anew
    at each use, and within a lambda for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def running(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array of longs.

    In two levels (sums of blocks, then within a block), as `aggregate` copies its array at
    every step: the time grows as n * block rather than with the square of n.
    """
    zero = F.lit(0).cast("long")

    def sums(part: Column, first: Column) -> Column:
        """first, first + part[0], ...: one longer than the part."""
        return F.aggregate(part, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def inner(x: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(block))
        totals = F.transform(begins, lambda i: F.aggregate(F.slice(x, i, F.lit(block)), zero, lambda a, v: a + v))
        return let(
            sums(totals, zero),
            lambda starts: F.slice(
                F.flatten(
                    F.transform(
                        begins,
                        lambda i, k: let(F.slice(x, i, F.lit(block)), lambda part: F.slice(sums(part, F.get(starts, k)), F.lit(1), F.size(part))),
                    )
                ),
                F.lit(1),
                F.size(x),
            ),
        )

    return let(lengths, inner)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s,e,m>>, in code points, end exclusive.

    The text between matches comes from `split` with the same pattern, so the running sums of
    the lengths of both are the places; no user function is needed.
    """
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")

    def placed(found: Column, gaps: Column) -> Column:
        size = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return let(
            running(size),
            lambda at: F.transform(
                found,
                lambda m, i: let(
                    F.get(at, i) + F.length(F.get(gaps, i)),
                    lambda s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")),
                ),
            ),
        )

    def body(t: Column) -> Column:
        return let(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda found: F.when(F.size(found) <= 0, none).otherwise(let(F.split(t, pattern, -1), lambda gaps: placed(found, gaps))),
        )

    return let(text, body)
