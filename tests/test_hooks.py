"""Extension hooks: model embedder with quarantine (U2), binary extractor (U4)."""

import os
import tempfile

from pyspark.sql import functions as F

from lectern.operators.embed import embed_with, hashed_embedding
from lectern.params import Params
from lectern.sources.files import binary_elements


def test_embed_with_batches_and_quarantine(spark):
    calls = []

    def model(texts):
        calls.append(len(texts))
        if any("boom" in t for t in texts):
            raise ValueError("model failed")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "boom" if i == 5 else f"text {i}") for i in range(10)], "id long, text string")
    out = embed_with(df.coalesce(1), "text", model, Params(embed_batch=4)).orderBy("id").collect()
    assert [r["embedding"] is None for r in out] == [False] * 4 + [True] * 4 + [False] * 2
    assert all(r["embed_error"].startswith("ValueError") for r in out if r["embedding"] is None)
    assert out[0]["embedding"] == [6.0, 1.0]


def test_chunks_with_another_tokenizer(spark):
    from lectern.operators.chunking import chunk_elements
    letters = lambda c: F.regexp_extract_all(c, F.lit("[a-z]"), 0)
    df = spark.createDataFrame([("f", 1, "abc"), ("f", 2, "123"), ("f", 3, "defghijkl")], "file string, ord long, text string")
    p = Params(chunk_size=4, chunk_overlap=1, max_chunk_tokens=6)
    got = chunk_elements(df, params=p, tokenizer=letters, detokenizer=lambda t: F.array_join(t, "-")).orderBy("chunk_no", "chunk_part")
    assert [r.content for r in got.collect()] == ["abc", "d-e-f-g", "g-h-i-j", "j-k-l"]


def test_empty_extraction_is_tried_again_as_one_element(spark):
    root = tempfile.mkdtemp(prefix="lectern-retry-")
    for name in ("a.pdf", "b.pdf"):
        with open(os.path.join(root, name), "wb") as f:
            f.write(name.encode())
    el, bad = binary_elements(spark, root, lambda p, b: [] if b == b"a.pdf" else ["x", "y"], lambda p, b: [b.decode()])
    assert sorted(r["text"] for r in el.collect()) == ["a.pdf", "x", "y"] and bad.count() == 0


def test_hashed_embedding_counts_words(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "   "), (3, None)], "id long, t string")
    rows = {r["id"]: r["embedding"] for r in hashed_embedding(df, ["id"], "t", dim=8).collect()}
    assert sum(rows[1]) == 3.0 and max(rows[1]) == 2.0 and len(rows[1]) == 8
    assert rows[2] is None and rows[3] is None


def test_binary_elements_with_quarantine(spark):
    root = tempfile.mkdtemp(prefix="lectern-bin-")
    for name, body in [("a.pdf", b"one\ntwo"), ("bad.pptx", b"\xff"), ("skip.txt", b"x")]:
        with open(os.path.join(root, name), "wb") as f:
            f.write(body)

    def extractor(path, data):
        return data.decode("utf-8").split("\n")   # fails on the invalid byte

    els, bad = binary_elements(spark, root, extractor)
    got = sorted((os.path.basename(r["path"]), r["element_no"], r["text"]) for r in els.collect())
    assert got == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["bad.pptx"]
    assert bad.where(F.col("error").startswith("UnicodeDecodeError")).count() == 1


def test_query_blocks_are_copied_within_their_own_key_only(spark):
    """A key's query blocks go to as many salts as it has groups of corpus blocks, whatever the other keys hold."""
    from pyspark.sql import functions as F
    from lectern.operators import knn
    block = "key string, dim int, n int, ids array<long>, data binary"
    stored = spark.createDataFrame([("hot", 4, 1, [i], b"") for i in range(41)] + [(f"k{i}", 4, 1, [i], b"") for i in range(30)], block)
    asked = spark.createDataFrame([(k, 4, 1, [0], b"") for k in ["hot", "hot", "none", *[f"k{i}" for i in range(30)]]], block)
    c, q = knn.salted(stored, asked, ["key", "dim"])
    copies = {r.key: r.n for r in q.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert copies.pop("hot") == 2 * 11 and set(copies.values()) == {1}
    assert {r.salt for r in c.where("key <> 'hot'").collect()} == {0}
    assert {r.salt for r in c.where("key = 'hot'").collect()} <= set(range(11))


def test_words_and_vectors_need_no_extraction_by_pattern(spark):
    """A pattern extraction copies the whole text for each word; the words are those it would find."""
    from pyspark.sql import functions as F

    from lectern.functions.text import WS, WS_CLASS, token_count, words
    from lectern.operators.embed import hash_bucket
    rows = [(0, None), (1, ""), (2, WS), (3, "one"), (4, f"{WS}a{WS}B b{WS}"), (5, "x\u2003\u00c9t\u00e9\x1fA\U0001f600 \x00 a"), (6, " ".join(map(str, range(5000))))]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    found = F.regexp_extract_all("t", F.lit(f"[^{WS_CLASS}]+"), 0)
    buckets = F.transform(F.regexp_extract_all(F.lower("t"), F.lit(f"[^{WS_CLASS}]+"), 0), lambda w: hash_bucket(w, 8))
    vec = hashed_embedding(df, ["id"], "t", dim=8)
    plan = vec.select("embedding", words(F.col("t")), token_count(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    for r in vec.select("*", words(F.col("t")).alias("w"), token_count(F.col("t")).alias("n"), found.alias("f"), buckets.alias("b")).collect():
        assert r.w == r.f and r.n == (None if r.t is None else len(r.f))
        assert r.embedding == ([float(r.b.count(i)) for i in range(8)] if r.b else None)
