"""Quality rules, sharding, decontamination, SimHash and packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tests.conftest import SF, SF01
from tests.llm.fixtures import awkward, documents, write
from tidewright.llm import decontam, packing, quality, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["sf", "awkward", "empty"])
def sf(request, tmp_path_factory):
    if request.param == "sf":
        return SF01
    folder = tmp_path_factory.mktemp(request.param)
    items = [(1, "w1 w2 w3 w4 w5 w6 w7 w8"), (2, "two three"), (3, None), (4, ""), (5, "W3 w4 w5 w6 w7 w8 w9 w10 w1"), (6, "smile"), (10, "w2 w3 w4 w5 w6 w7 w8 w9")]
    return write(folder, benchmark=items) if request.param == "awkward" else write(folder, [], [])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quality(spark, sf):
    def brute(d, t):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c, hit = Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                hit |= {i, i + 1, i + 2}
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return d, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base

    got = rows(quality.op7_quality_rules(spark, sf))
    assert Counter(r[:-1] for r in got) == Counter(brute(*x) for x in documents(sf))
    assert not any(r[-1] for r in got if r[-2])


def test_quality_matches_labels_and_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SF01}/documents.parquet'")
    got = rows(quality.op7_quality_rules(spark, SF01))
    assert Counter(con.sql(quality.OP7_SQL).fetchall()) == Counter(got)
    good = dict(con.sql(f"SELECT doc_id, quality FROM '{SF01}/labels.parquet'").fetchall())
    judged = [(good[r[0]], r[-1]) for r in got if r[0] in good and not r[-2]]
    assert all(kept for q, kept in judged if q == 1)
    assert np.mean([kept for q, kept in judged if q == 0]) < 0.1


def test_sharding(spark, sf):
    got = rows(sharding.op5_sharding(spark, sf))
    docs = documents(sf)
    assert Counter(r[:3] for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    by = defaultdict(list)
    for r in got:
        by[r[4]].append(r)
    assert {r[3] for r in got} <= {"bytes"} and all(r[6] is None for r in got)
    for rs in by.values():
        assert sorted(r[5] for r in rs) == list(range(len(rs)))
    if got:
        most, total = max(r[1] for r in got), sum(r[1] for r in got)
        assert set(by) <= set(range(8))
        assert all(abs(sum(r[1] for r in rs) - total / 8) <= most for rs in by.values())


def test_sharding_hot_text(spark, tmp_path):
    n = 6000
    sf = write(tmp_path, list(range(n)), ["copy " * 20 if i % 3 else f"text {i} " * (1 + i % 40) for i in range(n)])
    got = rows(sharding.op5_sharding(spark, sf))
    size = Counter()
    for r in got:
        size[r[4]] += r[1]
    assert len(size) == 8 and max(size.values()) - min(size.values()) < 1000
    assert got == [] or Counter(got) == Counter(rows(sharding.op5_sharding(spark, sf)))
    # Equal texts lie next to each other, over neighbouring shards at most where one ends.
    line = [r[2] for r in sorted(got, key=lambda r: (r[4], r[5]))]
    runs = [crc for i, crc in enumerate(line) if i == 0 or line[i - 1] != crc]
    assert len(runs) == len(set(runs))


def test_range_of_a_key(spark):
    cuts = sorted({int(x) for x in np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 700)})
    keys = [cuts[0] - 1, *cuts[::50], *(c + 1 for c in cuts[::70]), cuts[-1] + 5]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [r[0] for r in df.select(sharding._range_of(df.k, cuts)).collect()] == [sum(c <= k for c in cuts) for k in keys]


def brute_overlaps(docs, items, n=8):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if k else ():
            windows[tuple(w[a : a + k])].add(str(i))
    sizes = sorted({len(k) for k in windows})
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if got := windows.get(tuple(w[a : a + k])):
                    found |= got
                    hit |= set(range(a, a + k))
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


def test_decontamination(spark, sf):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    expect = Counter(brute_overlaps(documents(sf), items))
    assert Counter(rows(decontam.op4_decontamination(spark, sf))) == expect


def test_decontamination_in_blocks(spark):
    docs, bench = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontam.find_overlaps(docs.select("doc_id", "text"), bench).drop("text")
    many = decontam.find_overlaps(docs.select("doc_id", "text"), bench, block_words=500).drop("text")
    key = lambda r: (r[0], r[1] and bytes(r[1]), r[2], tuple(r[3]))
    assert Counter(map(key, rows(one))) == Counter(map(key, rows(many)))


def test_decontamination_of_a_repeated_word_is_linear():
    items = [("1", [b"w"] * 60_000), ("2", [b"w"] * 3 + [b"x"] * 4)]
    automaton = decontam.ItemAutomaton(items, 8)
    hit, found = automaton.scan([b"w"] * 120_000 + [b"x"] * 4)
    assert hit.all() and found == {"1", "2"}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 5, "x", 1.0, "y")], "doc_id long, text string, _hit long, _items string, _cuts double, _th string")
    bench = spark.createDataFrame([(7, "c d e f g h i j")], "item_id long, text string")
    assert decontam.decontaminate(docs, bench, coverage=0.9).collect()[0][1:] == ("a b ", 5, "x", 1.0, "y")
    assert simhash.drop_near_duplicates(docs).collect() == docs.collect()
    assert quality.keep_good(docs).count() == 0


def test_encoder_leaves_other_files_to_the_tokenizer(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    made = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    made["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(made))
    texts = ["Plain Words HERE", "x 12's don't", "É à B"]
    for path in (str(public_tokenizers.path("word_bpe_49k.json")), str(tmp_path / "cased.json")):
        own = Tokenizer.from_file(path)
        assert [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(path).encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.Encoder(str(public_tokenizers.path("word_bpe_49k.json"))).short and not packing.Encoder(str(tmp_path / "cased.json")).short


def test_decontaminated_texts(spark):
    docs, bench = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = decontam.decontaminate(docs, bench)
    assert clean.schema == docs.schema
    again = decontam.find_overlaps(clean, bench)
    assert again.where("__tw_hit IS NOT NULL").count() < 0.1 * decontam.find_overlaps(docs, bench).where("__tw_hit IS NOT NULL").count()
    before, after = dict(documents(SF01)), {r.doc_id: r.text for r in clean.collect()}
    hit = {r[0] for r in brute_overlaps(documents(SF01), duckdb.sql(f"SELECT * FROM '{SF01}/benchmark.parquet'").fetchall()) if r[2]}
    assert all(after[d] == t for d, t in before.items() if d not in hit)


def brute_print(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, prints, radius=2):
    own = sorted(set(prints))
    parent = {p: p for p in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(own, np.uint64)
    for i, p in enumerate(own):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            parent[root(own[j])] = root(p)
    least = {}
    for d, p in zip(ids, prints):
        r = root(p)
        least[r] = d if least.get(r) is None else min(least[r], d) if d is not None else least[r]
    return [least[root(p)] for p in prints]


def test_simhash(spark, sf):
    docs = documents(sf)
    prints = [brute_print(t) for _, t in docs]
    expect = Counter((d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, brute_components([d for d, _ in docs], prints)))
    assert Counter(rows(simhash.op2_simhash(spark, sf))) == expect


@pytest.mark.parametrize("bucket", [8192, 4])
def test_links_of_dense_fingerprints(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for b in base for _ in range(60)]
    fps = sorted(set(fps))
    ids = list(range(len(fps)))
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in fps], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.near_links(table, bucket=bucket)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in fps]
    mine = defaultdict(list)
    for i, p in enumerate(signed):
        mine[found.get(p, p)].append(i)
    expect = defaultdict(list)
    for i, c in enumerate(brute_components(ids, fps)):
        expect[c].append(i)
    assert sorted(mine.values()) == sorted(expect.values())


def brute_similar(texts, width=5, similar=0.8):
    """Components of texts by the Jaccard similarity of their shingle sets, as lists of places."""
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))))
    at = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similar * len(a | sets[j]):
                old, new = at[i], at[j]
                at = [new if x == old else x for x in at]
    by = defaultdict(list)
    for i, x in enumerate(at):
        by[x].append(i)
    return list(by.values())


def test_one_of_each_group_stays(spark, tmp_path):
    sf = write(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids, texts = awkward()
    expect = Counter(min((ids[i] for i in g), key=lambda d: (d is None, d or 0)) for g in brute_similar(texts))
    assert Counter(r.doc_id for r in kept.collect()) == expect


def test_near_duplicates_of_texts(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for group in range(30):
        base = rng.choice(words, int(rng.integers(60, 400))).tolist()
        for _ in range(int(rng.integers(1, 13))):
            new = list(base)
            for i in rng.choice(len(new), int(rng.integers(0, max(2, len(new) // 45))), replace=False):
                new[i] = "changed"
            texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(min(g) for g in brute_similar(texts))
    assert simhash.drop_near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """Texts at 0.786 to each other share their band keys; pairs among them are at 0.818."""
    base = [f"b{i}" for i in range(92)]
    texts = []
    for i in range(300):
        middle = [f"p{i // 2}", f"q{i // 2}"] if i < 120 else [f"p{i}x", f"q{i}x"]
        texts.append(" ".join([*base, *middle, *(f"u{i}.{j}" for j in range(10))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [*range(0, 120, 2), *range(120, 300)]


def test_near_duplicates_with_a_repeated_sentence(spark):
    """Repeats leave the set of shingles as it is but weigh in a fingerprint."""
    texts = []
    for i in range(40):
        head, again = [f"h{i}.{j}" for j in range(100)], [f"s{i}.{j}" for j in range(5)]
        texts += [" ".join([*head, *again]), " ".join([*head, *again * 18])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == list(range(0, 80, 2))


def test_near_duplicates_by_fingerprints_alone(spark):
    """Without band keys SimHash groups still bring their texts together, all of them, and the
    exact comparison decides: 20 pairs, a crowd of 12, and texts of one fingerprint unlike in their sets."""
    texts = []
    for i in range(20):
        base = [f"a{i}.{j}" for j in range(600)]
        texts += [" ".join(base), " ".join([*base, "end"])]
    base = [f"b{j}" for j in range(900)]
    texts += [" ".join([*base, f"end{i}"]) for i in range(12)]
    texts += [" ".join([*(f"c{i}.{j}" for j in range(40)), *["x y z"] * 400]) for i in range(12)]
    assert len({simhash.fingerprint(t.encode()) for t in texts[-12:]}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "u long, text string")
    traits = simhash._traits(docs.select(docs.u.alias("_id"), simhash.F.xxhash64("text").alias("_th"), "text"), 5)
    assert [r.fp & (1 << 64) - 1 for r in traits.sort("_id").collect()] == [brute_print(t) for t in texts]
    bare = traits.select(traits._id.alias("u"), "fp", "size", simhash.F.array().cast("array<long>").alias("keys"))
    found = {r.node: r.root for r in simhash.components(simhash.similar_links(bare, docs)).collect()}
    prints = brute_components(range(len(texts)), [brute_print(t) for t in texts])
    groups = [g for g in brute_similar(texts) if len(g) > 1]
    assert [sorted(g) for g in groups if len({prints[i] for i in g}) == 1]
    expect = {}
    for g in groups:
        for same in {prints[i] for i in g}:
            members = [i for i in g if prints[i] == same]
            expect |= {i: members[0] for i in members if len(members) > 1}
    assert found == expect and sum(v == 40 for v in found.values()) > simhash.SMALL


def test_blocks_share_what_sets_share():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 120))).astype(np.uint64)) for _ in range(30)]
    left, right = np.arange(12), np.arange(12, 30)
    expect = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert simhash._common(sets, left, right, step=37).tolist() == expect


def brute_pieces(docs, width=4096):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for d, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), width)):
            part = ids[s : s + width]
            yield d, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def test_packing(spark, sf):
    got = rows(packing.op8_packing(spark, sf))
    assert Counter(r[:5] for r in got) == Counter(brute_pieces(documents(sf)))
    by = defaultdict(list)
    for r in got:
        by[r[5]].append((r[6], r[3]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= 1.02 * -(-sum(r[3] for r in got) // 4096) + 1


def test_packing_tree(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 300, 4000).tolist()
    pieces = spark.createDataFrame([(i, i, 0, s) for i, s in enumerate(sizes)], "_id long, _bin long, _at long, length long").withColumn("_fill", simhash.F.col("length"))
    out = packing.pack(pieces, width=1000, group=300).collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by.values())) == len(sizes)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1000
    assert len(by) <= 1.05 * sum(sizes) / 1000


def test_best_fit_is_best_fit():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert len(fills) == 2 and fills.tolist() == [10, 10] and bins.tolist() == [0, 1, 0, 1, 1]
