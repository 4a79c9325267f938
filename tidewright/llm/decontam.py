"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, table

#: ASCII: digits and letters stay, A-Z become a-z, all else parts words. Other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Item words per automaton; a larger benchmark is searched block by block, one pass each.
BLOCK_WORDS = 2_000_000


def split_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lowered."""
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the words of many items.

    A state stands for the word sequences that end at the same places. `grams[state]` has the
    items in which the window (its `n` last words) of that state's sequences occurs; `short`
    has whole items of fewer words.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for item, words in items if words]
        for _, words in ids:
            state = 0
            for w in words:
                state = self._extend(state, w)
        self._window: dict[int, int] = {}
        self.grams: dict[int, set[str]] = {}
        self.short: dict[int, set[tuple[int, str]]] = {}
        for item, words in ids:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= n:
                    self.grams.setdefault(self._shorten(state, n), set()).add(item)
            if len(words) < n:
                self.short.setdefault(self._shorten(state, len(words)), set()).add((len(words), item))
        self.least = min((min(n, len(words)) for _, words in ids), default=n)
        self._above: dict[int, list[tuple[int, str]]] = {}
        # Neighbouring words of items, as a table of hashed pairs: a filter that may let more pass.
        size = 1 << min(26, max(16, (4 * sum(len(w) for _, w in ids)).bit_length() + 3))
        self.mask, self.pairs = size - 1, np.zeros(size, dtype=bool)
        for _, words in ids:
            a = np.asarray(words, dtype=np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & self.mask

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest sequence and w, as a state of its own."""
        q = self.next[p][w]
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        here, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = here
            p = self.link[p]
        if p >= 0:
            self.link[here] = self._split(p, w)
        return here

    def _shorten(self, state: int, n: int) -> int:
        """The state of the last n words of the state's sequences; the way up to a window's state
        is remembered, as it is long where a word repeats itself."""
        passed = []
        while self.length[self.link[state]] >= n:
            if n == self.n:
                if (known := self._window.get(state)) is not None:
                    state = known
                    break
                passed.append(state)
            state = self.link[state]
        for s in passed:
            self._window[s] = state
        return state

    def _ending(self, state: int) -> list[tuple[int, str]]:
        """Short items that are suffixes of the state's longest sequence."""
        passed = []
        while state > 0 and state not in self._above:
            passed.append(state)
            state = self.link[state]
        found = self._above.get(state, []) if state > 0 else []
        for s in reversed(passed):
            if own := self.short.get(s):
                found = [*own, *found]
            self._above[s] = found
        return found

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """For every word whether an occurring window covers it, and the items of these windows."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        if len(words) < self.least:
            return hit, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
        # Only where neighbours are neighbours in some item can a window of two words or more occur.
        joined = (ids[:-1] > 0) & (ids[1:] > 0) & self.pairs[self._slot(ids[:-1], ids[1:])] if self.least > 1 else np.ones(len(ids) - 1, dtype=bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + 1 >= self.least:
                self._walk(ids[a : b + 1].tolist(), a, hit, items)
        if self.least == 1 and len(ids) == 1:
            self._walk(ids.tolist(), 0, hit, items)
        return hit, items

    def _walk(self, ids: list[int], at: int, hit: np.ndarray, items: set[str]) -> None:
        state = matched = 0
        for i, w in enumerate(ids, at):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w not in self.next[state]:
                continue
            state, matched = self.next[state][w], matched + 1
            if matched >= self.n:
                hit[i - self.n + 1 : i + 1] = True
                items |= self.grams[self._shorten(state, self.n)]
            if self.short:
                for length, item in self._ending(state):
                    if length <= matched:
                        hit[i - length + 1 : i + 1] = True
                        items.add(item)


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> tuple[int, DataFrame]:
    """The number of blocks of about `limit` words each, and the benchmark's items with their block."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.encode(F.col(text), "UTF-8").alias("text")).where("text IS NOT NULL AND item IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(size // (6 * limit)) + 1
    return n, rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))


_FOUND = "__tw_hit binary, __tw_n_words long, __tw_items array<string>"


def _scan_block(block, n: int):
    """A function for mapInArrow: adds a block's hits (packed bits) and items to those found before."""
    built = {}

    def run(batches):
        if not built:
            built[0] = ItemAutomaton([(i, split_words(t)) for i, t in block.value], n)
        automaton = built[0]
        for batch in batches:
            hits, counts, found = [], [], []
            old_hits, old_items = batch.column("__tw_hit").to_pylist(), batch.column("__tw_items").to_pylist()
            for text, bits, before in zip(batch.column("__tw_text").cast(pa.binary()).to_pylist(), old_hits, old_items):
                words = split_words(text)
                hit, names = automaton.scan(words)
                if before:
                    hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                    names |= set(before)
                hits.append(np.packbits(hit).tobytes() if names else None)
                counts.append(len(words))
                found.append(sorted(names))
            keep = [batch.column(i) for i, f in enumerate(batch.schema.names) if f not in ("__tw_hit", "__tw_n_words", "__tw_items")]
            names = [f for f in batch.schema.names if f not in ("__tw_hit", "__tw_n_words", "__tw_items")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(hits, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=[*names, "__tw_hit", "__tw_n_words", "__tw_items"]
            )

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 8, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add to each document `__tw_hit` (packed bits, one a word; null if none), `__tw_n_words`, `__tw_items`.

    An item's windows are its runs of n words; an item of fewer words, but not none, is one
    window. Null and empty texts have no words; null items are ignored; an empty benchmark hits
    nothing; repeated rows are judged alike; an empty table gives no rows; texts are read in
    whole, however long. Names that begin with `__tw_` are ours. Text is streamed once a block of
    the benchmark: a block of about `block_words` words is collected and broadcast, its hits are
    written to the shared folder, and it is let go before the next one comes.
    """
    sc = docs.sparkSession.sparkContext
    found = docs.withColumns({"__tw_text": F.col(text), "__tw_hit": F.lit(None).cast("binary"), "__tw_n_words": F.lit(0).cast("long"), "__tw_items": F.array().cast("array<string>")})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    many, rows = _blocks(benchmark, item, item_text, block_words)
    for k in range(many):
        block = sc.broadcast([(r.item, bytes(r.text)) for r in rows.where(F.col("block") == k).collect()])
        found = found.transform(in_arrow, _scan_block(block, n), ", ".join([*fields, "__tw_text string", _FOUND]))
        if k < many - 1:
            found = materialize(found, "overlaps")
            block.unpersist()
    return found.drop("__tw_text")


def cut_spans(text: bytes, hit: np.ndarray, max_words: int, coverage: float) -> bytes:
    """A text without its runs of hit words of `max_words` or more; nothing of it if the hit
    share of its words is above `coverage`."""
    if hit.mean() > coverage:
        return b""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= max_words]
    if not runs:
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, max_words: int = 8, coverage: float = 0.5, text: str = "text") -> DataFrame:
    """Documents without the spans they share with the benchmark.

    Runs of at least `max_words` hit words are cut; a document of which more than `coverage` of
    the words are hit goes. All else, null and empty texts too, stays as it is, with its columns;
    repeated rows are judged alike, each for itself; an empty table gives no rows.
    """
    found = find_overlaps(docs, benchmark, n, text)

    def run(batches):
        for batch in batches:
            cols = {k: batch.column(k) for k in docs_columns}
            hits = batch.column("__tw_hit").to_pylist()
            if any(h is not None for h in hits):
                new = []
                for value, bits, count in zip(cols[text].cast(pa.binary()).to_pylist(), hits, batch.column("__tw_n_words").to_pylist()):
                    if bits is not None:
                        value = cut_spans(value, np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool), max_words, coverage)
                    new.append(value)
                gone = pa.array([b is not None and not v for v, b in zip(new, hits)])
                cols[text] = pa.array(new, pa.binary()).cast(batch.schema.field(text).type)
                kept = pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
                yield kept.filter(pa.compute.invert(gone))
            else:
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    docs_columns = docs.columns
    return found.transform(in_arrow, run, docs.schema)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole table documents."""
    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

    def digest(batches):
        for batch in batches:
            items = batch.column("__tw_items").to_pylist()
            hits = [0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in batch.column("__tw_hit").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("__tw_n_words"),
                    pa.array(hits, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
                    pa.array([len(x) >= 2 for x in items]),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.transform(in_arrow, digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
