"""Best-fit packing of tokenised documents by hierarchical merging of underfull bins."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, table

#: Tokens a sequence holds.
WIDTH = 4096
#: A bin with at most so many free places is emitted at once; others are merged further.
SLACK = 8
#: Bins that one task packs at a time, and the fan-in of the tree of merges.
GROUP = 100_000
#: Words whose ids a task remembers; the memory is emptied when it is full.
REMEMBERED = 300_000

# Texts of these characters only are split by the short pattern below just as the tokenizer does
# it after lowering; others go to the tokenizer in whole.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]|<\\|")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


# How a tokenizer file has to normalise and split for the short way.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """Little-endian 32-bit ids of texts, the tokenizer's own. Where the tokenizer's file lowers
    and splits as `_PART` does, a word's ids do not depend on its neighbours, so each word is
    tokenised once and remembered; any other file's texts go to the tokenizer in whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        said = json.loads(self.tokenizer.to_str())
        normal, split = said.get("normalizer") or {}, (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.short = (
            [x["type"] for x in normal.get("normalizers", ())] == _NORMAL
            and (split[0].get("pattern"), split[0].get("behavior"), split[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
            and [x.get("type") for x in split[1:]] == ["ByteLevel"]
            and not split[1].get("add_prefix_space")
            and not split[1].get("use_regex")
            and said["model"]["type"] == "BPE"
        )
        # The model's alphabet is bytes as characters: visible ones stand for themselves, the
        # others for characters from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in visible)}
        self.alphabet = {c: "".join(of[b] for b in chr(c).encode()) for c in range(128, 256)}

    def _learn(self, parts) -> None:
        tokenize, alphabet = self.model.tokenize, self.alphabet
        if len(self.known) + len(parts) > REMEMBERED:
            self.known = {}
        for p in parts:
            self.known[p] = struct.pack(f"<{len(t)}I", *[x.id for x in t]) if (t := tokenize(p.translate(alphabet))) else b""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            split, size, begin = [], 0, at
            while at < len(texts) and size < 1_000_000:  # characters at a time
                t = texts[at] or ""
                split.append(None if not self.short or _PLAIN.search(t) else _PART.findall(t.lower()))
                size, at = size + len(t), at + 1
            new: set[str] = set()
            for parts in split:
                if parts:
                    new.update(parts)
            new.difference_update(self.known)
            emptied = len(self.known) + len(new) > REMEMBERED
            if emptied:
                new = {p for parts in split if parts for p in parts}
            self._learn(new)
            get = self.known.__getitem__
            for k, parts in enumerate(split, begin):
                out.append(np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes() if parts is None else b"".join(map(get, parts)))
        return out


def best_fit(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in falling order: (bin of each item, offset in it, fill of each bin)."""
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    free: list[int] = []  # remaining places that some bin has, sorted
    holders: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(free, size)
        if k < len(free):
            room = free[k]
            b = holders[room].pop()
            if not holders[room]:
                del holders[room], free[k]
        else:
            room, b = width, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, width - room
        fills[b] = width - room + size
        if room := room - size:
            if room not in holders:
                insort(free, room)
                holders[room] = []
            holders[room].append(b)
    return bins, offsets, np.array(fills, np.int64)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of at most `width` ids: _id, piece, start, length, ids_crc32, and `_bin`, `_at`,
    `_fill` from best fit among the task's own pieces (in groups of bounded size)."""

    def run(batches):
        encoder, task, done = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close():
            nonlocal held, done
            ids, piece, start, length, crc = map(list, zip(*held)) if held else ([], [], [], [], [])
            bins, at, fills = best_fit(np.array(length, np.int64), width)
            cols = [pa.array(ids, kind), *[pa.array(x, pa.int64()) for x in (start, length, crc)], pa.array(piece, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (bins + done + (task << 36), at, fills[bins] if len(bins) else bins)]
            done, held = done + len(fills), []
            return pa.RecordBatch.from_arrays(cols, names=["_id", "start", "length", "ids_crc32", "piece", "_bin", "_at", "_fill"])

        kind = pa.int64()
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            kind = whole.schema.field("_id").type
            for at in range(0, whole.num_rows, 256):  # few texts at a time are Python's
                batch = whole.slice(at, 256)
                for d, ids in zip(batch.column("_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * width)):
                        part = ids[s : s + 4 * width]
                        held.append((d, k, s // 4, len(part) // 4, zlib.crc32(part)))
                if len(held) >= GROUP:
                    yield close()
        if held:
            yield close()

    kind = dict(docs.dtypes)[doc_id]
    schema = f"_id {kind}, start long, length long, ids_crc32 long, piece int, _bin long, _at long, _fill long"
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).transform(in_arrow, run, schema)


def _merge(bins: DataFrame, width: int) -> DataFrame:
    """One round: the bins of each group as items for best fit; (bin, into, shift, fill)."""

    def run(batches):
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by("bin")
        ids, fill = rows.column("bin").to_numpy(), rows.column("fill").to_numpy()
        for at in range(0, len(ids), GROUP):
            part = slice(at, at + GROUP)
            b, shift, fills = best_fit(fill[part], width)
            name = np.empty(len(fills), np.int64)
            name[b[::-1]] = ids[part][::-1]  # a merged bin is called like the first that went into it
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[part], name[b], shift, fills[b])], names=["bin", "into", "shift", "fill"])

    return bins.transform(in_arrow, run, "bin long, into long, shift long, fill long")


def pack(pieces: DataFrame, width: int = WIDTH, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """Pieces with `sequence_id` and `offset`.

    The bins that the tasks packed for themselves are taken up in a tree: bins with at most
    `slack` free places are emitted, the underfull ones of some tasks meet in one group of about
    `group` bins, are packed again as items, and so on with ever fewer groups. The last rounds
    hold one group; a round's table is slim (a bin's name and fill) and written to the shared
    folder. If a single group would be overfull, groups of a bounded size remain side by side.
    """
    bins = materialize(pieces.groupBy(F.col("_bin").alias("bin")).agg(F.max("_fill").alias("fill")), "pack-bins")
    under = bins.where(F.col("fill") < width - slack)
    moved = None
    n = under.count()
    while n > 1:
        # Neighbours by fill would not fill each other; a hash of the name mixes all sizes.
        groups = max(1, -(-n // group))
        into = materialize(_merge(under.repartition(groups, F.xxhash64("bin", F.lit(n))), width), "pack-round")
        step = into.select(F.col("bin").alias("b"), F.col("into").alias("to"), F.col("shift").alias("by"))
        if moved is None:
            moved = step.select(F.col("b").alias("bin"), F.col("to").alias("into"), F.col("by").alias("shift"))
        else:
            moved = materialize(moved.join(step, F.col("into") == F.col("b"), "left").select("bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")), "pack-moved")
        under = into.groupBy(F.col("into").alias("bin")).agg(F.max("fill").alias("fill")).where(F.col("fill") < width - slack)
        before, n = n, under.count()
        if n > 0.98 * before or groups == 1:
            break
    if moved is None:
        return pieces.withColumns({"sequence_id": F.col("_bin"), "offset": F.col("_at")}).drop("_bin", "_at", "_fill")
    out = pieces.join(moved.withColumnRenamed("bin", "_b"), F.col("_bin") == F.col("_b"), "left")
    return out.withColumns({"sequence_id": F.coalesce("into", "_bin"), "offset": F.col("_at") + F.coalesce("shift", F.lit(0))}).drop("_bin", "_at", "_fill", "_b", "into", "shift")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents as pieces in sequences of at most `width` ids: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    Every document ends with `end_id`; only longer ones are cut, at multiples of `width`. Null and
    empty texts are the end id alone; null ids stay null; repeated rows are documents of their
    own; an empty table gives no rows. tokenizer: the path of a tokenizer file.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(tokenise(docs, str(tokenizer), end_id, width, text, doc_id), "pack-pieces")
    out = pack(pieces, width)
    return out.select(F.col("_id").alias(doc_id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole table documents."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
