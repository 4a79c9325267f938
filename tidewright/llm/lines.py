"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_arrow, let, materialize, row_key

#: Lines over which the rolling hash that sets a border runs, and the mean number of lines between borders.
WINDOW, MEAN_LINES = 2, 3
#: Words that a chunk needs to be worth comparing; a line, or a least run of lines, with as many is a
#: chunk of its own too.
MIN_WORDS = 10
_BASE = 0x100000001B3
_MASK = (1 << 64) - 1


def chunks(text: bytes | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first line, end line) of a text's chunks of `min_words` words or more.

    A border falls behind a line where the rolling hash of the last lines' hashes is 0 modulo
    the mean length, so borders move with the lines when others are put in or taken out before
    them. Lines without words belong to no chunk. Long lines are chunks of their own as well, and
    from every shorter line the least run of lines with `min_words` words is one, forwards and
    backwards: such runs inside a passage of as many words cover all its lines, so that it is
    found whatever stands beside it.
    """
    if not text:
        return []
    out, begin, words, roll = [], None, 0, []
    lines = text.split(b"\n")
    held: list[int] = []
    places: list[int] = []
    ends = [0]

    def close() -> None:
        nonlocal begin, words
        if len(held) > 1 and words >= min_words:
            out.append((xxhash.xxh64_intdigest(b"\n".join(lines[i] for i in held), 1), held[0], held[-1] + 1))
        held.clear()
        words = 0

    for i, line in enumerate(lines):
        n = len(line.split())
        if not n:
            continue
        h = xxhash.xxh64_intdigest(line)
        if n >= min_words:
            out.append((h, i, i + 1))
        held.append(i)
        places.append(i)
        ends.append(ends[-1] + n)
        words += n
        roll = [*roll[1 - WINDOW :], h]
        value = 0
        for x in roll:
            value = (value * _BASE + x) & _MASK
        if (value >> 17) % MEAN_LINES == 0:
            close()
    close()
    runs = {}  # in order, each once
    for k in range(len(places)):
        if ends[k + 1] - ends[k] < min_words:
            a, b = bisect_right(ends, ends[k + 1] - min_words) - 1, bisect_left(ends, ends[k] + min_words)
            if a >= 0:
                runs[a, k + 1] = None
            if b < len(ends):
                runs[k, b] = None
    there = {c[1:] for c in out}
    for a, b in runs:
        lo, hi = places[a], places[b - 1] + 1
        if (lo, hi) not in there:
            out.append((xxhash.xxh64_intdigest(b"\n".join(lines[i] for i in places[a:b]), 1), lo, hi))
    return out


def _hashes(docs: DataFrame, min_words: int) -> DataFrame:
    """One row a chunk: h."""

    def run(batches):
        for batch in batches:
            h = [c[0] for t in batch.column(0).cast(pa.binary()).to_pylist() for c in chunks(t, min_words)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], names=["h"])

    return docs.select("t").transform(in_arrow, run, "h long")


def _held(docs: DataFrame, passing: np.ndarray, min_words: int) -> DataFrame:
    """_id, _th, h, lo, hi, bytes and their digest d of the chunks whose hash passes the filter."""
    shipped = docs.sparkSession.sparkContext.broadcast(passing)

    def run(batches):
        bits = shipped.value
        mask = len(bits) * 8 - 1
        for batch in batches:
            at, rows = [], []
            for k, t in enumerate(batch.column("t").cast(pa.binary()).to_pylist()):
                lines = None
                for h, lo, hi in chunks(t, min_words):
                    slot = h & mask
                    if bits[slot >> 3] >> (slot & 7) & 1:
                        lines = lines or t.split(b"\n")
                        body = b"\n".join(x for x in lines[lo:hi] if x.split())
                        at.append(k)
                        rows.append((h - (1 << 64) if h >> 63 else h, lo, hi, body, hashlib.sha256(body).digest()))
            h, lo, hi, body, d = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            cols = [batch.column("_id").take(pa.array(at, pa.int64())), batch.column("_th").take(pa.array(at, pa.int64())), pa.array(h, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(body, pa.binary()), pa.array(d, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_th", "h", "lo", "hi", "bytes", "d"])

    kind = dict(docs.dtypes)["_id"]
    return docs.transform(in_arrow, run, f"_id {kind}, _th long, h long, lo int, hi int, bytes binary, d binary")


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _th, and `cuts`: array<struct<lo,hi>> of the line ranges to remove from a document.

    A chunk that occurs twice or more, anywhere, stays where it comes first (by id, hash of the
    text, line) and is removed elsewhere. A first pass counts hashes; in a second one only chunks
    that may be repeated leave their documents, and are grouped by their bytes, so only equal
    bytes count as repeats. The digest just brings a group's first place back to its members.
    """
    slim = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(text).alias("t"))
    repeated = materialize(_hashes(slim, min_words).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "line-hashes")
    held = materialize(_held(slim, bit_filter(repeated, "h"), min_words), "line-chunks")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_id"), F.col("_th").alias("_th"), F.col("lo").alias("lo"))
    same = held.groupBy("h", "bytes").agg(F.min(place).alias("first"), F.first("d").alias("d"), F.count("*").alias("n")).where("n > 1").select("h", "d", "first")
    again = held.drop("bytes").withColumn("place", place).join(same, ["h", "d"]).where(F.col("place") != F.col("first"))
    return again.groupBy("_id", "_th").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the chunks that stand elsewhere before; all rows and columns stay.

    Null and empty texts stay as they are; a text of which nothing is left is empty. Rows alike
    in id and text are one document, whose chunks do not repeat each other. An empty table gives
    no rows; texts are read in whole, however long; names that begin with `__tw_` are ours.
    `min_words` is the least number of words of a chunk that counts.
    """
    cuts = materialize(find_repeats(docs, text, doc_id, min_words).select(F.col("_id").alias("__tw_i"), F.col("_th").alias("__tw_t"), F.col("cuts").alias("__tw_cuts")), "line-cuts")
    # A sort-merge join at every size: a broadcast would do for few cuts, but not for many.
    joined = docs.hint("merge").join(cuts, docs[doc_id].eqNullSafe(cuts["__tw_i"]) & (F.xxhash64(docs[text]) == cuts["__tw_t"]), "left")
    gone = F.flatten(F.transform("__tw_cuts", lambda c: F.sequence(c["lo"], c["hi"] - 1)))
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    left = F.array_join(let(F.split(docs[text], "\n", -1), kept), "\n")
    return joined.withColumn(text, F.when(F.col("__tw_cuts").isNull(), docs[text]).otherwise(left)).select(*docs.columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents after line dedup: doc_id, lines removed, and the text that is left."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))))
    left = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", (F.col("n_lines") - left).cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), "text")
