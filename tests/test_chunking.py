"""Differential tests of the chunker against a direct sequential simulation."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking
from lectern.params import Params


def simulate(elements, p: Params):
    """Plain sequential chunking of one file's ordered (ord, text) elements with
    whitespace tokens -- written straight from the spec, for comparison."""
    C, O, M = p.chunk_size, p.chunk_overlap, p.max_chunk_tokens
    out, buf, bt, slides = [], [], 0, []

    def flush():
        out.append(("\n\n".join(buf), None, list(slides)))

    for ord_, text in elements:
        t = text.strip()
        toks = t.split()
        n = len(toks)
        if n == 0:
            continue
        if n > M:
            if buf:
                flush()
                buf, bt, slides = [], 0, []
            starts = list(range(0, n, C - O))
            for i, s in enumerate(starts):
                out.append((" ".join(toks[s:s + C]), (i + 1, len(starts)), [ord_]))
            continue
        if buf and bt + n > C:
            flush()
            joined = "\n\n".join(buf).split()
            ov = "\n\n".join(buf) if len(joined) <= O else " ".join(joined[-O:])
            buf = [ov]
            bt = min(O, len(joined))
            slides = []
        buf.append(t)
        bt += n
        slides.append(ord_)
    if buf:
        flush()
    return out


def random_file(rng):
    sizes = rng.choice([[0, 1, 2, 5], [29, 30, 31], [170, 199, 200, 201], [299, 300, 301, 450], [10, 60, 120]])
    n_el = rng.randint(1, 40)
    els = []
    for i in range(n_el):
        n = rng.choice(sizes) if rng.random() < 0.8 else rng.randint(0, 700)
        words = [f"w{rng.randint(0, 99)}" for _ in range(n)]
        sep = rng.choice([" ", "  ", "\t"])
        els.append((i + 1, ("  " if rng.random() < 0.2 else "") + sep.join(words)))
    return els


@pytest.mark.parametrize("block,superblock", [(65536, 4096), (3, 4096), (3, 2), (2, 3)])
def test_chunker_matches_simulation(spark, block, superblock):
    rng = random.Random(7 + block + superblock)
    p = Params(chunk_block=block, chunk_superblock=superblock)
    files = {f"f{i}": random_file(rng) for i in range(60)}
    rows = [(f, o, t) for f, els in files.items() for o, t in els]
    df = spark.createDataFrame(rows, "file string, ord long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups straddle batches
    try:
        got = chunking.chunk_elements(df, params=p).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"], []).append(r)
    for f, els in files.items():
        want = simulate(els, p)
        rs = sorted(by_file.get(f, []), key=lambda r: (r["chunk_no"], r["chunk_part"] or 0))
        assert [r["content"] for r in rs] == [w[0] for w in want], f
        assert [(r["chunk_part"], r["total_parts"]) if r["chunk_part"] else None for r in rs] == [w[1] for w in want]
        assert [r["slides_covered"] or [r["slide_number"]] for r in rs] == [w[2] for w in want]


def test_token_windows_column(spark):
    text = " ".join(f"t{i}" for i in range(400))
    df = spark.createDataFrame([(text,), ("short text",)], "x string")
    w = df.select(chunking.token_windows(F.col("x")).alias("w")).collect()
    assert len(w[0]["w"]) == 3 and w[0]["w"][2].split()[0] == "t340"
    assert w[1]["w"] == ["short text"]
