"""Language-model scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_arrow, materialize, table

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b""  # the token after a text's words; no word is empty

#: Least count of a next word that a context has for its own, and so of both words, at any input
#: size: the tables of contexts grow with the input.
MIN_COUNT = 30
#: Training tokens of a bucket of word pairs or of keys, and the most buckets there are.
BUCKET_TOKENS, BUCKETS = 4_000_000, 1_000_000
#: Keys, or else texts, after which a task that scores sends what it holds.
HELD_KEYS, HELD_TEXTS = 1_500_000, 100_000
#: Least share of the training tokens of what is broadcast: words, which make the alphabet, and
#: next words in their contexts. For words and contexts of one word it is a cache and changes no
#: result; contexts of more words have this share, or `MIN_COUNT` if that is more.
P_HEAD = 1e-6
DEPTH = 3
DISCOUNT = 0.5
END_PLACE = 0


def tokens(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, then one end."""
    return [*text.translate(_FOLD).split(), END] if text else [END]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 7 is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(word, c): every token's count, pre-aggregated in each task."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens(t))
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select(text).transform(in_arrow, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def name_of(word: bytes) -> int:
    """A word's name in tables: 63 bits of its hash, negative."""
    return ~(xxhash.xxh64_intdigest(word, 42) >> 1)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _mix(x: np.ndarray, seed=np.uint64(42)) -> np.ndarray:
    """XXH64 of longs, as the expression xxhash64 gives it."""
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = (seed + _P5 + np.uint64(8)) ^ (turn(x.view(np.uint64) * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _pairs(a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Keys of contexts and next words: xxhash64(a, s)."""
    return _mix(s, _mix(a)).view(np.int64)


def _passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the bits of `bit_filter` let pass."""
    slot = keys & (len(bits) * 8 - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _packed(x: np.ndarray) -> bytes:
    """Longs as bytes, the highest ones of all first: those of small numbers compress away."""
    return np.ascontiguousarray(x.astype(">i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(">i8").reshape(-1).astype(np.int64)


def _tight(x: np.ndarray) -> bytes:
    """Longs, packed and compressed."""
    return pa.compress(_packed(x), codec="zstd", asbytes=True)


def _loose(x: bytes, n: int) -> np.ndarray:
    """The n longs of `_tight`."""
    return _unpacked(pa.decompress(x, 8 * n, codec="zstd", asbytes=True))


def _steps(x: np.ndarray) -> np.ndarray:
    """What each of the sorted longs adds to the one before it; their running sums are the longs."""
    return np.diff(x, prepend=np.int64(0))


def _keys(a: np.ndarray, s: np.ndarray, width: int) -> np.ndarray:
    """Keys of contexts and next words in the table: small codes where both have places, which
    travel in few bytes when sorted, and hashes of other pairs."""
    out, other = a * width + s, (a < 0) | (s < 0)
    out[other] = _pairs(a[other], s[other])
    return out


def _slots(keys: np.ndarray) -> np.ndarray:
    """Hashes of keys, for the filter."""
    return _mix(keys).view(np.int64)


def _buckets(total: int) -> int:
    return max(8, min(total // BUCKET_TOKENS, BUCKETS))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of keys by their buckets and then by themselves, and each bucket with its first
    place and its end there."""
    order = np.argsort(keys, kind="stable")
    bucket = ((_mix(keys[order]) >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    again = np.argsort(bucket, kind="stable")
    bucket = bucket[again]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return order[again], list(zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(keys)]))


@dataclass
class Level:
    """Contexts of one length over the alphabet. `keys` are suffix context * width + word before
    it, sorted; `names` the contexts at the same places. For kept contexts `back` has log10 of the
    weight of the suffix's distribution, and (`codes`, `logs`) next words with their log10
    probabilities; codes are context * width + word."""

    keys: np.ndarray
    names: np.ndarray
    strings: list[tuple[int, ...]]
    kept: np.ndarray | None = None
    back: np.ndarray | None = None
    codes: np.ndarray | None = None
    logs: np.ndarray | None = None


@dataclass
class Tree:
    """The `width` words of the alphabet have places by falling count (the end is 0). `passing` is the filter of the keys of all other contexts and next words."""

    width: int
    total: int
    types: int
    counts: np.ndarray
    base: np.ndarray  # log10 of the level-0 probability of each place
    levels: list[Level] = field(default_factory=list)
    passing: np.ndarray | None = None


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _before(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each position; a text begins as if an end came before it."""
    out = np.concatenate(([END_PLACE], ids[:-1]))
    out[first] = END_PLACE
    return out


def contexts(tree: Tree, symbols: np.ndarray, first: np.ndarray):
    """For each level in turn, the context of that length before every position, or -1.

    symbols: those of texts one after another, -1 outside the alphabet; first: the texts' first
    places. Before the end that a text begins with there is nothing.
    """
    n = len(symbols)
    context = _before(symbols, first)
    yield context
    here = np.arange(n)
    marks = np.zeros(n, np.int64)
    marks[first] = first
    starts = np.maximum.accumulate(marks)
    for k, level in enumerate(tree.levels[1:], 2):
        at = here - k
        left = np.where(at >= starts, symbols[np.maximum(at, 0)], np.where(at == starts - 1, END_PLACE, -1))
        ok = (context >= 0) & (left >= 0)
        place, there = _found(level.keys, np.where(ok, context * tree.width + left, -1))
        context = np.where(ok & there, level.names[place] if len(level.names) else -1, -1)
        yield context


def _chunks(column, words: int = 500_000):
    """(first row, ids of texts one after another, their first places) for some texts at a time."""
    part, size, begin = [], 0, 0
    for k, v in enumerate(column.to_pylist()):
        part.append(np.frombuffer(v, "<i8"))
        size += len(part[-1])
        if size >= words:
            yield begin, np.concatenate(part), np.cumsum([0, *map(len, part[:-1])])
            part, size, begin = [], 0, k + 1
    if part:
        yield begin, np.concatenate(part), np.cumsum([0, *map(len, part[:-1])])


def encode(docs: DataFrame, words: dict[bytes, int], doc_id: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """_id and ids (packed longs: a word's place, or its name if it has none) of every text: the one
    pass that reads words."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        get = shipped.value.get
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            ids = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                w = tokens(t)
                ids.append(np.fromiter([~(digest(x, 42) >> 1) if (i := get(x)) is None else i for x in w], "<i8", len(w)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *batch.columns[2:]], names=["_id", "ids", *extra])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"_id {kinds[doc_id]}, ids binary", *[f"{c} {kinds[c]}" for c in extra]])
    return docs.select(F.col(doc_id).alias("_id"), text, *extra).transform(in_arrow, run, schema)


def _count_pairs(encoded: DataFrame, tree_at, known: np.ndarray, total: int, min_count: int) -> DataFrame:
    """(a, s, n, q): each word and its next one that are together `min_count` times or more, how
    often they are, and the share of the next word (null for words without a place).

    Most pairs are rare, so they travel packed: a task sorts its pairs and leaves one row a bucket,
    and a bucket's rows are merged into its counts. Pairs of words with places are codes, dealt by
    these; others are dealt by a name, so that a task sends a name once for all its pairs. `known`
    is the filter of rare words that are frequent enough themselves.
    """
    buckets = _buckets(total)
    filter_at = encoded.sparkSession.sparkContext.broadcast(known)

    def merged(held):
        a, s, n = (np.concatenate(x) for x in zip(*held))
        _, at, back = np.unique(_pairs(a, s), return_index=True, return_inverse=True)
        return a[at], s[at], np.bincount(back, weights=n).astype(np.int64)

    def send(batches):
        bits, width, held, size = filter_at.value, tree_at.value.width, [], 0

        def out(a, s, n):
            # A pair's first part is its code, or else a name, and its other word the second part;
            # side tells codes (0), names before (1) and behind their other words (2) apart.
            side = np.where(a < 0, 1, np.where(s < 0, 2, 0)).astype(np.int8)
            x, y = np.where(side == 0, a * width + s, np.where(side == 1, a, s)), np.where(side == 0, 0, np.where(side == 1, s, a))
            order, parts = _dealt(x, buckets)
            x, y, side, n = x[order], y[order], side[order], n[order]
            packed = [pa.array([_tight(f(v[i:j])) for _, i, j in parts], pa.binary()) for f, v in ((_steps, x), (np.asarray, y), (np.asarray, side), (np.asarray, n))]
            return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in zip(*((b, j - i) for b, i, j in parts))), *packed], names=["bucket", "m", "x", "y", "side", "n"])

        for batch in batches:
            for _, ids, first in _chunks(batch.column(0)):
                fine = ids >= 0
                fine[~fine] = _passing(bits, ids[~fine])
                a = _before(ids, first)
                before = np.concatenate(([True], fine[:-1]))
                before[first] = True
                a, s = a[fine & before], ids[fine & before]
                _, at, n = np.unique(_pairs(a, s), return_index=True, return_counts=True)
                held.append((a[at], s[at], n))
                size += len(n)
                if size > 3_000_000:
                    done = merged(held)
                    if len(done[0]) > 1_500_000:
                        yield out(*done)
                        held, size = [], 0
                    else:
                        held, size = [done], len(done[0])
        if size:
            yield out(*merged(held))

    def receive(batches):
        tree, now, held = tree_at.value, None, []

        def out():
            a, s, n = merged(held)
            some = n >= min_count
            a, s, n = a[some], s[some], n[some]
            q = pa.array(np.where(s >= 0, 10.0 ** tree.base[np.maximum(s, 0)], 0.0), mask=s < 0)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), pa.array(n), q], names=["a", "s", "n", "q"])

        for batch in batches:
            for bucket, m, *packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "m", "x", "y", "side", "n"))):
                if bucket != now and held:
                    yield out()
                    held = []
                now = bucket
                x, y, side, n = (_loose(v, m) for v in packed)
                x = np.cumsum(x)
                held.append((np.where(side == 0, x // tree.width, np.where(side == 1, x, y)), np.where(side == 0, x % tree.width, np.where(side == 1, y, x)), n))
        if held:
            yield out()

    sent = encoded.select("ids").transform(in_arrow, send, "bucket long, m long, x binary, y binary, side binary, n binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").transform(in_arrow, receive, "a long, s long, n long, q double")


def _count_level(encoded: DataFrame, tree_at, often_at) -> DataFrame:
    """(code, n): next words of the deepest level's contexts, and code width for the context's
    total. A next word is only counted where it is frequent after the context's longest suffix
    (`often`: its codes), as it cannot be more frequent after the context itself."""

    def run(batches):
        tree, often = tree_at.value, often_at.value
        width = tree.width + 1
        codes, counts, held = [], [], 0

        def merged():
            c, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            return c, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for _, ids, first in _chunks(batch.column(0)):
                symbols = np.maximum(ids, -1)
                context = None
                for deeper in contexts(tree, symbols, first):
                    suffix, context = context, deeper
                ok = np.flatnonzero(context >= 0)
                c, s = context[ok] * width, symbols[ok]
                _, may = _found(often, np.where(s >= 0, suffix[ok] * tree.width + s, -1))
                some, n = np.unique(np.concatenate(((c + s)[may], c + tree.width)), return_counts=True)
                codes.append(some)
                counts.append(n)
                held += len(some)
                if held > 4_000_000:
                    c, n = merged()
                    if len(c) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["code", "n"])
                        codes, counts, held = [], [], 0
                    else:
                        codes, counts, held = [c], [n], len(c)
        if codes:
            c, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["code", "n"])

    return encoded.select("ids").transform(in_arrow, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _suffix_log(tree: Tree, string: tuple[int, ...], symbol: np.ndarray) -> np.ndarray:
    """log10 probabilities of words after a string's longest proper suffix, by the levels done."""
    out = tree.base[symbol].copy()
    for k in range(1, len(string)):
        level = tree.levels[k - 1]
        context = level.index[string[-k:]]
        if level.kept[context]:
            at, there = _found(level.codes, context * tree.width + symbol)
            out = np.where(there, level.logs[at] if len(level.logs) else 0.0, out + level.back[context])
    return out


def _deeper(tree: Tree, context: np.ndarray, symbol: np.ndarray) -> bool:
    """Add the contexts one longer than the last level's, from its next words; whether there are any."""
    level = tree.levels[-1]
    longer = [(*level.strings[c], int(s)) for c, s in zip(context.tolist(), symbol.tolist()) if s != END_PLACE]
    longer = [x for x in longer if x[1:] in level.index]
    if not longer:
        return False
    keys = np.array([level.index[x[1:]] * tree.width + x[0] for x in longer], np.int64)
    order = np.argsort(keys)
    tree.levels.append(Level(keys[order], np.arange(len(longer))[order], longer))
    tree.levels[-1].index = {x: i for i, x in enumerate(longer)}
    return True


def _first_level(tree: Tree, pairs: DataFrame, named: DataFrame, price: float, least: float) -> DataFrame:
    """Contexts of one word, of all words: kept ones and their next words as (h, delta).

    h is the key of a context and a next word (`_keys`), or of a context alone that is not in the alphabet; delta is what the longest suffix's log10 probability changes by there: the weight of
    the unlisted words for a context, and on top of it the word's own probability. Frequent
    contexts and next words become the first level of the broadcast tree instead.
    """
    share = (F.col("c") + 1.0) / float(tree.total + tree.types + 1)
    rare = named.withColumnRenamed("id", "s").where("s < 0 AND c > 1")
    rows = pairs.where("s >= 0").union(pairs.where("s < 0").drop("q").join(rare, "s").select("a", "s", "n", share.alias("q")))
    sums = rows.groupBy("a").agg(F.sum("n").alias("sn"), F.sum("q").alias("sq"), F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("t"), F.count("*").alias("m"))
    held = sums.join(named.withColumnRenamed("id", "a"), "a")
    c = F.col("c")
    r, rq = 1.0 - F.col("sn") / c, F.greatest(1.0 - F.col("sq"), F.lit(1e-12))
    divergence = (F.col("t") - F.col("sn") * F.log(c)) / c + F.when(r > 0, r * F.log(r / rq)).otherwise(0.0)
    back = F.log10(F.greatest((c - F.col("sn") + DISCOUNT * F.col("m")) / c, F.lit(1e-12)) / rq)
    kept = materialize(held.where(c * divergence >= price * (F.col("m") + 1)).select("a", "c", back.alias("back")), "pst-contexts")
    listed = rows.join(kept, "a").select("a", "s", "n", F.log10((F.col("n") - DISCOUNT) / c).alias("log"), "q", "back")
    level = Level(np.arange(tree.width), np.arange(tree.width), [(s,) for s in range(tree.width)], np.zeros(tree.width, bool), np.zeros(tree.width))
    level.index = {(s,): s for s in range(tree.width)}
    common = F.col("a").between(0, tree.width - 1)
    for x in kept.where(common).collect():  # at most 1 / P_HEAD rows
        level.kept[x.a], level.back[x.a] = True, x.back
    head = sorted((x.a * tree.width + x.s, x.log) for x in listed.where(F.col("n") >= least).select("a", "s", "log").collect())  # as many
    level.codes, level.logs = np.array([x[0] for x in head], np.int64), np.array([x[1] for x in head], np.float64)
    tree.levels.append(level)
    none = [F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base")]
    pair = F.when((F.col("a") >= 0) & (F.col("s") >= 0), F.col("a") * tree.width + F.col("s")).otherwise(F.xxhash64("a", "s"))
    entries = listed.where(F.col("n") < least).select(pair.alias("h"), *none, (F.col("log") - F.log10("q") - F.col("back")).alias("logs"))
    outside = kept.where(~common).select(F.xxhash64("a").alias("h"), *none, F.col("back").alias("logs"))
    more = F.log10(F.col("c") + 1.0)
    known = named.where("id < 0").select(F.col("id").alias("h"), F.lit(1).cast("long").alias("known"), more.alias("base"), more.alias("logs"))
    fixes = materialize(entries.union(outside).union(known), "pst-fixes")
    tree.passing = bit_filter(fixes.select(F.xxhash64("h").alias("h")), "h")
    return fixes


def _dictionary(counts: DataFrame, p_head: float) -> tuple[Tree, dict[bytes, int]]:
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = (F.col("c") >= p_head * total) | (F.col("word") == F.lit(END))
    frequent = [(bytes(r.word), r.c) for r in counts.where(often).collect()]  # at most 1 / p_head rows and the end
    frequent.sort(key=lambda r: (r[0] != END, -r[1], r[0]))
    frequent = frequent or [(END, 0)]
    known = np.array([c for _, c in frequent], np.float64)
    tree = Tree(len(frequent), int(total), int(types), known, np.log10((known + 1.0) / (total + types + 1.0)))
    return tree, {w: i for i, (w, _) in enumerate(frequent)}


def _learn(encoded: DataFrame, tree: Tree, words: dict[bytes, int], counts: DataFrame, p_head: float, depth: int, min_count: int) -> DataFrame:
    """Grow the tree from encoded texts; the table of the contexts that are not broadcast."""
    sc = encoded.sparkSession.sparkContext
    least = max(p_head * tree.total, min_count)
    price = 0.5 * math.log(max(tree.total, 2))
    words_at = sc.broadcast(words)

    def ids(batches):
        get = words_at.value.get
        for batch in batches:
            w = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([name_of(x) if (i := get(x)) is None else i for x in w], pa.int64()), batch.column(1)], names=["id", "c"])

    named = materialize(counts.transform(in_arrow, ids, "id long, c long"), "pst-named")
    known = bit_filter(named.where(F.col("id") < 0).where(F.col("c") >= min_count), "id")
    pairs = materialize(_count_pairs(encoded, sc.broadcast(tree), known, tree.total, min_count), "pst-pairs")
    fixes = _first_level(tree, pairs, named, price, least)
    often = [(r.a, r.s) for r in pairs.where(F.col("n") >= least).select("a", "s").collect() if 0 <= r.a < tree.width and 0 <= r.s < tree.width]  # at most 1 / p_head rows
    often.sort()
    context, symbol = np.array([x[0] for x in often], np.int64), np.array([x[1] for x in often], np.int64)
    n = tree.width
    for _ in range(2, depth + 1):
        codes = np.unique(context * n + symbol)
        if not _deeper(tree, context, symbol):
            break
        level = tree.levels[-1]
        shipped = sc.broadcast(tree)
        found = _count_level(encoded, shipped, sc.broadcast(codes))
        is_total = F.col("code") % (n + 1) == n
        rows = found.where(is_total | (F.col("n") >= least)).collect()  # at most 2 / p_head rows
        shipped.unpersist()
        code, seen = np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], np.float64)
        context, symbol = code // (n + 1), code % (n + 1)
        sums = np.ones(len(level.strings))
        sums[context[symbol == n]] = seen[symbol == n]
        inner = symbol < n
        context, symbol, seen = context[inner], symbol[inner], seen[inner]
        order = np.lexsort((symbol, context))
        context, symbol, seen = context[order], symbol[order], seen[order]
        level.kept, level.back = np.zeros(len(level.strings), bool), np.zeros(len(level.strings))
        codes, logs = [], []
        edges = np.flatnonzero(np.diff(context, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            c, s, m = int(context[a]), symbol[a:b], seen[a:b]
            lower = 10.0 ** _suffix_log(tree, level.strings[c], s)
            p = m / sums[c]
            r, q = max(1.0 - p.sum(), 0.0), max(1.0 - lower.sum(), 1e-12)
            divergence = float(np.sum(p * np.log(p / lower)) + (r * math.log(r / q) if r > 0 else 0.0))
            if sums[c] * divergence < price * (len(s) + 1):
                continue
            p = (m - DISCOUNT) / sums[c]
            level.kept[c], level.back[c] = True, math.log10(max(1.0 - p.sum(), 1e-12) / q)
            codes.append(c * n + s)
            logs.append(np.log10(p))
        level.codes, level.logs = (np.concatenate(codes), np.concatenate(logs)) if codes else (np.empty(0, np.int64), np.empty(0))
    for level in tree.levels:
        del level.index
        level.strings = []
    return fixes


def _score(encoded: DataFrame, tree: Tree, fixes: DataFrame) -> DataFrame:
    """_id, n_tokens, n_known, base_score and score of encoded texts.

    Keys travel packed: a task holds the keys of many texts (a chunk) and leaves one row a bucket
    of them, with each key once and the texts it is from. A bucket's table settles its rows, and
    leaves sums for the texts of a chunk, which meet them by the chunk.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(tree)
    buckets = _buckets(tree.total)

    def run(batches):
        tree = shipped.value
        bits, width = tree.passing, tree.width
        first_level, deeper = tree.levels[0], tree.levels[1:]
        chunk, texts, size, held = TaskContext.get().partitionId() << 36, 0, 0, []

        def out(kind):
            keys, owner = (np.concatenate(x) for x in zip(*held))
            order, parts = _dealt(keys, buckets)
            keys, owner = keys[order], owner[order]
            bucket, m, packed = [], [], []
            for b, i, j in parts:
                k = keys[i:j]
                begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                bucket.append(b)
                m.append(len(begin))
                packed.append([_tight(x) for x in (_steps(k[begin]), np.diff(np.append(begin, j - i)), owner[i:j])])
            n, none = len(parts), np.zeros(len(parts), np.int64)
            cols = [np.full(n, chunk), bucket, none, pa.nulls(n, kind), none, none, none * 0.0, none * 0.0, m]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols] + [pa.array(x, pa.binary()) for x in zip(*packed)], names=names)

        for batch in batches:
            kind = batch.column("_id").type
            for begin, ids, first in _chunks(batch.column("ids")):
                frequent = ids >= 0
                symbols = np.maximum(ids, -1)
                base = np.where(frequent, tree.base[np.maximum(ids, 0)], -math.log10(tree.total + tree.types + 1.0))
                each = contexts(tree, symbols, first)
                context = next(each)
                inside = context >= 0
                kept = inside & first_level.kept[context]
                at, listed = _found(first_level.codes, np.where(kept & (symbols >= 0), context * width + symbols, -1))
                logs = base + np.where(kept, first_level.back[context], 0.0)
                logs = np.where(listed, first_level.logs[at] if len(first_level.logs) else 0.0, logs)
                for level, context in zip(deeper, each):
                    if level.kept is None or not level.kept.any():
                        continue
                    ok = np.flatnonzero(context >= 0)
                    ok = ok[level.kept[context[ok]]]
                    code = np.where(symbols[ok] >= 0, context[ok] * width + symbols[ok], -1)
                    where, there = _found(level.codes, code)
                    logs[ok] = np.where(there, level.logs[where], logs[ok] + level.back[context[ok]])
                    listed[ok] |= there
                # What is not settled by the broadcast tree meets the table by its keys.
                open_ = np.flatnonzero(~listed & (kept | ~inside))
                a = _before(ids, first)[open_]
                h = _keys(a, ids[open_], width)
                pair, alone = _passing(bits, _slots(h)), np.flatnonzero(~inside[open_])
                a = _slots(a[alone])
                some = _passing(bits, _slots(a))
                rare = np.flatnonzero(~frequent)
                rare = rare[_passing(bits, _slots(ids[rare]))]
                keys, owner = np.concatenate((h[pair], a[some], ids[rare])), np.concatenate((open_[pair], open_[alone[some]], rare))
                sums = [np.add.reduceat(x, first) for x in (frequent.astype(np.int64), base, logs)]
                n = len(first)
                lengths, none = np.diff(np.append(first, len(ids))), pa.nulls(n, pa.binary())
                cols = [np.full(n, chunk), np.full(n, -1), np.arange(texts, texts + n), batch.column("_id").slice(begin, n), lengths, *sums, np.zeros(n, np.int64)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols] + [none] * 3, names=names)
                if len(keys):
                    held.append((keys, np.searchsorted(first, owner, side="right") - 1 + texts))
                texts, size = texts + n, size + len(keys)
                if size >= HELD_KEYS or texts >= HELD_TEXTS:
                    if held:
                        yield out(kind)
                    chunk, texts, size, held = chunk + 1, 0, 0, []
        if held:
            yield out(kind)

    def settle(batches):
        now, table, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, chunk, h, known, logs = (batch.column(c).to_numpy() for c in ("bucket", "chunk", "h", "known", "logs"))
            asks = chunk >= 0
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (asks[1:] != asks[:-1])) + 1
            rows = []
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
                if bucket[i] != now:
                    now, table, ready = bucket[i], [], None
                if not asks[i]:
                    table.append((h[i:j], known[i:j], logs[i:j]))
                    continue
                if ready is None:
                    if not table:
                        continue
                    ready = [np.concatenate(x) for x in zip(*table)]
                    order = np.argsort(ready[0])
                    ready = [x[order] for x in ready]
                for m, *packed in zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in ("m", "keys", "times", "texts"))):
                    at, there = _found(ready[0], np.cumsum(_loose(packed[0], m)))
                    times = _loose(packed[1], m)
                    text = _loose(packed[2], int(times.sum()))[np.repeat(there, times)]
                    at = np.repeat(at[there], times[there])
                    word, log = ready[1][at], ready[2][at]
                    n = np.bincount(text)
                    some = np.flatnonzero(n)
                    sums = [np.bincount(text, x)[some] for x in (word, word * log, (1 - word) * log)]
                    rows.append((chunk[i], now, len(some), *map(_tight, (_steps(some), sums[0].astype(np.int64), *(x.view(np.int64) for x in sums[1:])))))
                    i += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.binary()] * 4)], names=["chunk", "bucket", "m", "texts", "known", "base", "logs"])

    def gather(batches):
        now, held, sums = None, [], None

        def out():
            texts = pa.Table.from_batches(held)
            more = sums or [0, 0.0, 0.0]
            total = [pa.array(texts.column(c).to_numpy() + x) for c, x in zip(("known", "base", "logs"), more)]
            cols = [texts.column(c).combine_chunks() for c in ("_id", "n_tokens")]
            return pa.RecordBatch.from_arrays([*cols, *total], names=["_id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, bucket = (batch.column(c).to_numpy() for c in ("chunk", "bucket"))
            cut = np.flatnonzero(chunk[1:] != chunk[:-1]) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(chunk)]):
                if chunk[i] != now:
                    if held:
                        yield out()
                    now, held, sums = chunk[i], [], None
                k = i + int(np.searchsorted(bucket[i:j], 0))  # texts are first
                if k > i:
                    held.append(batch.slice(i, k - i).select(["_id", "n_tokens", "known", "base", "logs"]))
                if k < j and sums is None:
                    n = sum(x.num_rows for x in held)
                    sums = [np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
                part = batch.slice(k, j - k)
                for m, *packed in zip(*(part.column(c).to_pylist() for c in ("m", "texts", "more_known", "more_base", "more_logs"))):
                    text, known, base, logs = (_loose(x, m) for x in packed)
                    text, base = np.cumsum(text), base.view(np.float64)
                    sums[0][text] += known
                    sums[1][text] += base
                    sums[2][text] += base + logs.view(np.float64)
        if held:
            yield out()

    id_kind = dict(encoded.dtypes)["_id"]
    names = ["chunk", "bucket", "text", "_id", "n_tokens", "known", "base", "logs", "m", "keys", "times", "texts"]
    schema = f"chunk long, bucket long, text long, _id {id_kind}, n_tokens long, known long, base double, logs double, m long, keys binary, times binary, texts binary"
    seen = materialize(encoded.select("_id", "ids").transform(in_arrow, run, schema), "pst-scored")
    place = F.pmod(F.shiftrightunsigned(F.xxhash64("h"), 24), F.lit(buckets).cast("long"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
    entries = fixes.select(place.alias("bucket"), F.lit(-1).cast("long").alias("chunk"), "h", "known", "logs", zero.alias("m"), *[none.alias(c) for c in ("keys", "times", "texts")])
    asked = seen.where("bucket >= 0").select("bucket", "chunk", zero.alias("h"), zero.alias("known"), F.lit(0.0).alias("logs"), "m", "keys", "times", "texts")
    settled = entries.union(asked).repartition("bucket").sortWithinPartitions("bucket", "chunk").transform(in_arrow, settle, "chunk long, bucket long, m long, texts binary, known binary, base binary, logs binary")
    answers = settled.select("chunk", "bucket", zero.alias("text"), F.lit(None).cast(id_kind).alias("_id"), zero.alias("n_tokens"), zero.alias("known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("logs"), "m", "texts", *[F.col(c).alias(f"more_{c}") for c in ("known", "base", "logs")])
    texts = seen.where("bucket < 0").select("chunk", "bucket", "text", "_id", "n_tokens", "known", "base", "logs", "m", *[none.alias(c) for c in ("texts", "more_known", "more_base", "more_logs")])
    both = texts.union(answers).repartition("chunk").sortWithinPartitions("chunk", "bucket", "text")
    return both.transform(in_arrow, gather, f"_id {id_kind}, n_tokens long, n_known long, base_score double, score double")


@dataclass
class Model:
    """A tree, its dictionary, and the table of the words and contexts that are not broadcast."""

    tree: Tree
    words: dict[bytes, int]
    fixes: DataFrame


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", p_head: float = P_HEAD, depth: int = DEPTH, min_count: int = MIN_COUNT) -> Model:
    """The suffix tree of the documents' words.

    Every word is a context, and has the next words that follow it `min_count` times or more for
    its own; these are tables that grow with the input. Over the alphabet (words with a share of
    `p_head`), contexts with that share are extended on the left up to `depth` words. A context is
    kept if its next-word distribution diverges from its longest suffix's by more than its own
    number of parameters is worth (n * KL over ln(N) / 2 for each next word held). Other words
    share what the discounted own ones leave, in proportion to the suffix's distribution; that of
    no context is the smoothed share of each word. Null and empty texts are one end; an empty
    table gives a model that knows nothing.
    """
    counts = materialize(count_tokens(docs, text), "pst-counts")
    tree, words = _dictionary(counts, p_head)
    encoded = materialize(encode(docs, words, doc_id, text), "pst-encoded")
    return Model(tree, words, _learn(encoded, tree, words, counts, p_head, depth, min_count))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, n_tokens, n_known, base_score and score of every row.

    A position's state is the longest kept context before it. What the broadcast part of the tree
    does not settle leaves a text as keys, which meet the table by their buckets; so do words outside
    the alphabet, for their counts. Null and empty texts are one end token; texts are read in whole; repeated
    rows are scored alike, each for itself; an empty table gives no rows.
    """
    encoded = materialize(encode(docs, model.words, doc_id, text), "pst-encoded")
    return _score(encoded, model.tree, model.fixes)


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The contract's scores of the whole table documents, encoded once for learning and scoring."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held"))
    counts = materialize(count_tokens(docs.where(~F.col("held")), "text"), "pst-counts")
    tree, words = _dictionary(counts, P_HEAD)
    encoded = materialize(encode(docs, words, "doc_id", "text", ("held",)), "pst-encoded")
    fixes = _learn(encoded.where(~F.col("held")), tree, words, counts, P_HEAD, DEPTH, MIN_COUNT)
    out = _score(encoded, tree, fixes)
    return out.select(F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
