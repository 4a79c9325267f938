"""Small tables with every awkward case: nulls, empty and long texts, copies, repeated rows, ties."""

import pyarrow as pa
import pyarrow.parquet as pq

LONG = "Ouwhea the of rend and " * 30_000


def awkward():
    texts = [
        None, "", " \t\n", "one", "one two", "one two three", "one two three", "One TWO three four five six",
        "é ü x  y ß", "a\nb\na\n\nb\n \n", "\U0001f600 smile \U0001f600", "x" * 20_000, LONG, LONG + "end",
        "mail me at a.b@c.example.org or +44 (20) 7946-0958 now; ip 10.0.0.255, 999.1.1.1; card 4111 1111 1111 1111.",
        "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 " * 3, "the cat sat on the mat " * 12, "don't we'll <|endoftext|> ΑΣ ﬁ İ ²",
    ]
    ids = [None, *range(1, len(texts))]
    ids += [3, 14, None, 5]  # repeated rows, repeated ids and nulls
    texts += ["one", "another text under an old id", None, "one two three"]
    return ids, texts


def write(folder, ids=None, texts=None, benchmark=(), extra=True):
    """A folder of tables like the driver's, with columns whose names clash with our own."""
    if ids is None:
        ids, texts = awkward()
    cols = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None] * len(ids), pa.string()), "source": pa.array(["s"] * len(ids)), "n_chars": pa.array([None] * len(ids), pa.int64())}
    if extra:
        cols |= {"n_words": pa.array(["clash"] * len(ids)), "shard": pa.array([9] * len(ids)), "component_id": pa.array([1.5] * len(ids))}
    pq.write_table(pa.table(cols), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in benchmark], pa.int64()), "text": pa.array([t for _, t in benchmark], pa.string())}), folder / "benchmark.parquet")
    return str(folder)


def documents(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"]))
