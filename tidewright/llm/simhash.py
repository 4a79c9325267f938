"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, table
from .components import components

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: A key's fingerprints up to this number are compared by their pivot distances within one task;
#: larger keys go the way of `_by_centres`, which compares none.
BUCKET = 8192
N_PIVOTS = 16


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, repeats included; of fewer words, of them all."""
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; of none, zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 16384):
        part = h[at : at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fold(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lowered."""
    return text.translate(_FOLD).split() if text else []


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of `width`-word shingles, repeats included; no words give zero."""
    return majority(shingles(fold(text), width))


def with_fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """Add `_fp`, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column("_text").cast(pa.binary()).to_pylist()], np.uint64)
            names = [f for f in batch.schema.names if f != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in names], pa.array(fps.view(np.int64), pa.int64())], names=[*names, "_fp"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.withColumn("_text", F.col(text)).transform(in_arrow, run, ", ".join([*fields, "_fp long"]))


def _masks(radius: int, same: int = 2) -> list[int]:
    """Bit masks of block pairs: of radius + same blocks, fingerprints at most radius apart agree
    on `same` blocks at least, so on some mask in whole."""
    n = radius + same
    cut = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(n)]
    return [a | b for a, b in combinations(blocks, 2)] if same == 2 else blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, from a hash of their number."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], np.uint64)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int8)


def _links_within(fps: np.ndarray, radius: int, refs: np.ndarray, step: int = 1024) -> list[tuple[int, int]]:
    """Links that connect what lies within `radius` in one bucket, as (fingerprint, root).

    The table of distances to the pivots is made first. Sorted by the first one, a row can only
    reach rows at most `radius` further on; of these, pairs that differ by more in any
    coordinate are discarded, and the Hamming distance verifies the rest. Blocks of `step` rows
    bound the memory; a forest instead of all pairs bounds the output.
    """
    distance = np.stack([_bits(fps ^ p) for p in refs])
    order = np.argsort(distance[0], kind="stable")
    fps, distance = fps[order], np.ascontiguousarray(distance[:, order])
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    limit = np.searchsorted(distance[0], distance[0] + radius, side="right")
    for a in range(0, len(fps), step):
        b, c = min(a + step, len(fps)), int(limit[min(a + step, len(fps)) - 1])
        for k in range(a, c, step):
            m = min(k + step, c)
            near = np.abs(distance[0, a:b, None] - distance[0, None, k:m]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + k
            i, j = i[i < j], j[i < j]
            for d in distance[1:]:
                if not len(i):
                    break
                keep = np.abs(d[i] - d[j]) <= radius
                i, j = i[keep], j[keep]
            keep = _bits(fps[i] ^ fps[j]) <= radius
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return [(int(fps[i]), int(fps[r])) for i in range(len(fps)) if (r := root(i)) != i]


def _by_pivots(keyed: DataFrame, radius: int) -> DataFrame:
    """Links from buckets of bounded size, which come sorted by key."""
    refs = pivots()

    def run(batches):
        key, held = None, []

        def close():
            fps = np.unique(np.array(held, np.int64).view(np.uint64))
            return _links_within(fps, radius, refs) if len(fps) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for m, k, fp in zip(batch.column("m").to_pylist(), batch.column("k").to_pylist(), batch.column("fp").to_pylist()):
                if (m, k) != key:
                    out += close() if len(held) > 1 else []
                    key, held = (m, k), []
                held.append(fp)
            pairs = np.array(out, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])
        pairs = np.array(close() if len(held) > 1 else [], np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])

    return keyed.select("m", "k", "fp").repartition("m", "k").sortWithinPartitions("m", "k").transform(in_arrow, run, "a long, b long")


def _by_centres(fps: DataFrame, radius: int) -> DataFrame:
    """Links of overfull keys without any comparison: two fingerprints at most 2r apart share a
    fingerprint at most r from both, so each names its surroundings and meets the least
    fingerprint there. Linear in the rows; for radius 2 (r = 1) 65 names each."""
    if radius != 2:
        raise ValueError("overfull keys need radius 2")
    near = fps.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("c"))
    least = near.groupBy("c").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return near.join(least, "c").select(F.col("fp").alias("a"), "b").where("a <> b")


def near_links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints `fp` at most `radius` bits apart."""
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for i, x in enumerate(_masks(radius))])).alias("x")).select("fp", "x.m", "x.k")
    sizes = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "simhash-keys")
    small = keyed.join(sizes.where(F.col("n") <= bucket).select("m", "k"), ["m", "k"])
    links = _by_pivots(small, radius)
    full = sizes.where(F.col("n") > bucket)
    if full.isEmpty():
        return links
    hot = keyed.join(full.select("m", "k"), ["m", "k"]).select("fp").distinct()
    return links.union(_by_centres(hot, radius))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: `_id`, `_fp`, `_component` (the least id reachable, itself included).

    Fingerprints link at `radius` or fewer differing bits; texts without words (null, empty) have
    fingerprint zero and link like any other. Copies meet in one fingerprint, so groups of any
    size cost one row each from there on. Null ids take part but name no group, unless it has no
    other; an empty table gives no rows.
    """
    slim = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("text"))
    prints = materialize(with_fingerprints(slim, width).drop("text"), "simhash")
    fps = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("least")).select(F.col("_fp").alias("fp"), "least"), "simhash-fps")
    found = components(near_links(fps.select("fp"), radius))
    of = fps.join(found, fps.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("_component"))
    named = of.join(ids, "root").select(F.col("fp").alias("_fp"), "_component")
    return prints.join(named, "_fp").select("_id", "_fp", "_component")


#: Near-duplicates of texts: words a shingle, and the least share of shingles in common.
SHINGLE, SIMILAR = 5, 0.8
#: Band keys of a text, and MinHash rows of each: two texts at 0.8 share one with a probability of 0.9996.
BANDS, ROWS = 20, 5
#: Texts that share a key are compared pair by pair up to this number; of more, block by block.
SMALL = 8
#: Texts of a block, on average.
BLOCK = 128


def band_keys(h: np.ndarray) -> list[int]:
    """Band keys of a set of shingle hashes, as signed longs."""
    if not len(h):
        return []
    turns = np.array([xxhash.xxh64_intdigest(b"row %d" % i, SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)
    least = np.full(len(turns), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        np.minimum(least, (h[at : at + 4096, None] * turns).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(rows[b].tobytes(), b)) for b in range(BANDS)]


def _traits(docs: DataFrame, width: int) -> DataFrame:
    """_id, _th, `same` (a digest of the word sequence), fp (the fingerprint of op2), size (of the
    shingle set) and keys of every row."""

    def run(batches):
        for batch in batches:
            same, fps, sizes, keys = [], [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                words = fold(t)
                h = np.unique(shingles(words, width))
                same.append(xxhash.xxh3_128_digest(b" ".join(words), SEED))
                fps.append(_signed(majority(shingles(words, 3))))
                sizes.append(len(h))
                keys.append(band_keys(h))
            cols = [batch.column("_id"), batch.column("_th"), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_th", "same", "fp", "size", "keys"])

    return docs.transform(in_arrow, run, f"_id {dict(docs.dtypes)['_id']}, _th long, same binary, fp long, size long, keys array<long>")


def _by_prints(texts: DataFrame, radius: int = 2) -> DataFrame:
    """(u, size, k): the SimHash group of every text as its key, the component of the links that
    `near_links` finds by pivots. Keys of one text are left in."""
    prints = materialize(texts.select("fp").distinct(), "near-prints")
    found = components(near_links(prints, radius))
    return texts.join(found, F.col("fp") == F.col("node"), "left").select("u", "size", F.coalesce("root", "fp").alias("k"))


def _alike(pairs: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have a Jaccard similarity of `similar` or more."""

    def run(batches):
        last, known = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").cast(pa.binary()).to_pylist(), batch.column("y").cast(pa.binary()).to_pylist()):
                if known is None or x != last:
                    last, known = x, np.unique(shingles(fold(x), width))
                other = np.unique(shingles(fold(y), width))
                both = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(both >= similar * (len(known) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = {c: texts.select(F.col("u").alias(c), F.col("text").alias(t)) for c, t in (("a", "x"), ("b", "y"))}
    read = pairs.join(named["a"], "a").join(named["b"], "b").select("a", "b", "x", "y")
    kind = dict(pairs.dtypes)["a"]
    return read.transform(in_arrow, run, f"a {kind}, b {kind}")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int = 4096) -> np.ndarray:
    """Elements in common of each set in `left` (places in `sets`) with each in `right`.

    Elements of one set only are left out; `step` of the others at a time become columns of a
    matrix of zeros and ones, which bounds the memory.
    """
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    column = np.concatenate(([0], np.cumsum(every[order][1:] != every[order][:-1])))
    several = np.bincount(column) > 1
    owner, column = owner[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    out = np.zeros((len(left), len(right)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        has = np.zeros((len(sets), min(step, int(column[-1]) + 1 - at)), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        out += has[left] @ has[right].T
    return out


def _links_between(rows: list[tuple], width: int, similar: float) -> list[tuple]:
    """Links (a, b) between the two blocks of `rows` (u, c, block, text), or within the one there
    is: a forest that connects all that are alike. Texts of one component c are connected before."""
    sets = [np.unique(shingles(fold(r[3]), width)) for r in rows]
    sides = np.array([r[2] for r in rows])
    left, right = np.nonzero(sides == sides.min())[0], np.nonzero(sides == sides.max())[0]
    sizes = np.array([len(x) for x in sets], np.float64)
    both = _common(sets, left, right)
    i, j = np.nonzero(both >= similar * (sizes[left][:, None] + sizes[right][None, :] - both))
    seen: dict = {}
    parent = [seen.setdefault(r[1], k) for k, r in enumerate(rows)]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist()):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((rows[x][0], rows[y][0]))
    return out


def _by_blocks(crowd: DataFrame, found: DataFrame, docs: DataFrame, width: int, similar: float, block: int = BLOCK) -> DataFrame:
    """The links of overfull keys (k, u) that `found` does not connect already; no pair is left out.

    Components of what is found come first; a key that lies in one is done. In the others the
    component of the first text, which is most of a large group of near copies, is dealt into
    blocks by a hash, and so is the rest; each block of the rest meets all blocks, itself
    included, in a group of its own, where the shingle sets are compared exactly.
    """
    known = components(found)
    of = crowd.select("k", "u").join(known, F.col("u") == F.col("node"), "left").select("k", "u", F.coalesce("root", "u").alias("c"))
    of = materialize(of, "near-crowd")
    main = of.groupBy("k").agg(F.min(F.struct("u", "c")).alias("first"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    of = of.join(main.select("k", F.col("first.c").alias("main")), "k").withColumn("inner", F.col("c") == F.col("main")).drop("main")
    of = materialize(of, "near-crowd")
    sizes = of.groupBy("k").agg(*[F.ceil(F.count_if(x) / block).cast("int").alias(n) for n, x in (("m", F.col("inner")), ("r", ~F.col("inner")))])
    read = materialize(docs.join(of.select("u").distinct(), "u", "left_semi").dropDuplicates(["u"]).select("u", "text"), "near-texts")
    own = F.when(F.col("inner"), F.pmod(F.xxhash64("u"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("u"), F.col("r"))).cast("int")
    met = F.sequence(F.when(F.col("inner"), F.col("m")).otherwise(0), F.col("m") + F.col("r") - 1)
    dealt = of.join(sizes, "k").select("k", "u", "c", own.alias("own"), F.explode(met).alias("other"))
    dealt = dealt.select("k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "u", "c", "own")

    def run(batches):
        key, rows, kind = None, [], None
        for batch in batches:
            kind, out = batch.schema.field("u").type, []
            columns = [batch.column(n).to_pylist() for n in ("k", "p", "q", "u", "c", "own")]
            for k, p, q, u, c, side, t in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
                if (k, p, q) != key:
                    out += _links_between(rows, width, similar) if len(rows) > 1 else []
                    key, rows = (k, p, q), []
                rows.append((u, tuple(c.values()) if isinstance(c, dict) else c, side, t))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kind) for n in (0, 1)], names=["a", "b"])
        out = _links_between(rows, width, similar) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kind) for n in (0, 1)], names=["a", "b"])

    kind = dict(crowd.dtypes)["u"]
    return dealt.join(read, "u").repartition("k", "p", "q").sortWithinPartitions("k", "p", "q").transform(in_arrow, run, f"a {kind}, b {kind}")


def similar_links(texts: DataFrame, docs: DataFrame, width: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) of near-duplicates among distinct texts.

    texts: u (what names a text and orders it), fp, size, keys; docs: u, text. Texts that share a
    key meet: their SimHash group (`_by_prints`) is one, and as fingerprints of texts at 0.8 differ
    in more bits than such a group spans, band keys are the others. Pairs of which one's shingle
    set is too small for the other's are discarded, and the sets of the rest are compared. A key of
    more than `SMALL` texts has its texts compared with the first of them, which connects most of a
    group of near copies; what is not connected by then is compared by `_by_blocks`, so that every
    pair of a key is connected or compared.
    """
    held = texts.select("u", "size", F.explode("keys").alias("k")).union(_by_prints(texts))
    several = held.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    held = materialize(held.join(several, "k"), "near-keys")
    first = held.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("u", "size")).alias("first"))
    few = held.join(first.where(F.col("n") <= SMALL).select("k"), "k")
    other = few.select("k", F.col("u").alias("u2"), F.col("size").alias("size2"))
    met = few.join(other, "k").where("u < u2").select("u", "size", "u2", "size2")
    crowd = held.join(first.where(F.col("n") > SMALL).select("k", F.col("first.u").alias("u2"), F.col("first.size").alias("size2")), "k")
    crowd = materialize(crowd, "near-crowd")
    met = met.union(crowd.where("u <> u2").select("u", "size", "u2", "size2"))
    near = met.where(F.least("size", "size2") >= F.lit(similar) * F.greatest("size", "size2"))
    pairs = materialize(near.select(F.col("u").alias("b"), F.col("u2").alias("a")).distinct(), "near-pairs")
    named = pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct()
    read = materialize(docs.join(named, "u", "left_semi").dropDuplicates(["u"]), "near-texts")
    found = materialize(_alike(pairs.select("a", "b"), read, width, similar), "near-links")
    if crowd.isEmpty():
        return found
    return found.union(materialize(_by_blocks(crowd, found, docs, width, similar), "near-links"))


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR, width: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id (null ids
    last); its columns are as they were. Of rows alike in id and text one stays.

    Texts link if their sets of `width`-word shingles (of fewer words, of them all; A-Z lowered)
    have a Jaccard similarity of `similar` or more; equal word sequences, and texts without
    words, are one text from the start. An empty table gives no rows.
    """
    slim = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("text"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_id"), F.col("_th").alias("_th"))
    traits = materialize(_traits(slim, width), "near-traits")
    texts = materialize(traits.groupBy("same").agg(F.min(order).alias("u"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")).drop("same"), "near-texts")
    found = components(similar_links(texts, slim.select(order.alias("u"), "text"), width, similar))
    gone = found.where("node <> root").select(F.col("node").alias("u"))
    keep = materialize(texts.select("u").join(gone, "u", "left_anti").select(F.col("u._id").alias("__tw_id"), F.col("u._th").alias("__tw_th")), "near-kept")
    kept = docs.join(keep, docs[doc_id].eqNullSafe(keep["__tw_id"]) & (F.xxhash64(docs[text]) == keep["__tw_th"]), "left_semi")
    repeated = traits.groupBy("_id", "_th").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.withColumn("__tw_th", F.xxhash64(text)).dropDuplicates([doc_id, "__tw_th"]).drop("__tw_th")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole table documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
