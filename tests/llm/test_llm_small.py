"""Training-data operators on small frames: brute force, nulls, empty and long texts, ties, repeated rows,
empty tables, extra and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import (bpe_count, chat, components, induced_sort, langid, minhash, mixing, quality, repeats,
                         sentencepiece_fst, sharding, topk)

SF = "/root/testdata/sf0.001"
BPE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
DOC = "doc_id long, text string, lang string, node string, label string, rate double, __row int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else None, "x", "y", 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def odd_texts():
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9000)) for _ in range(30_000))
    base = " ".join(f"w{i} of the text" for i in range(40))
    return [None, "", " \n\t ", "one", "Two words", base, base, base + " tail", base.upper(), long, long + " x",
            "a" * 5000, "ab" * 700, "ünïcödé 🎉 \x00 </s> <|endoftext|> [INST]", "한국어 텍스트 " * 30,
            "line one is here\n" * 40, "### $$$ !!! " * 60]


# -- 1 sharding --------------------------------------------------------------------------------
def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_function(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -2**63, 123456789, *range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 37):
        got = df.select("k", sharding.jump_shards(F.col("k"), n).alias("s")).select("k", "s.*").collect()
        assert [(r.shard, r.grown_shard) for r in got] == [(jump(r.k, n), jump(r.k, n + 1)) for r in got]


def test_shards_of_odd_rows(spark):
    texts = odd_texts()
    ids = [None, 3, 3, *range(3, 3 + len(texts) - 3)]
    docs = frame(spark, texts, ids=ids)
    docs = docs.union(docs.where("text = 'one'")).union(docs.where("text = 'one'"))
    got = sharding.shard_documents(docs).collect()
    want = [(ids[i], t) for i, t in enumerate(texts)] + [(ids[3], "one")] * 2
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.shard == jump(r.doc_id or 0, 16) and r.grown_shard == jump(r.doc_id or 0, 17)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_ids_that_are_no_integers(spark):
    text = "a passage of plain words that stands in two documents " * 8
    docs = frame(spark, [text, "own words " + text, "one", None]).withColumn(
        "doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    got = sharding.shard_documents(docs).collect()
    assert sorted(r.doc_id for r in got) == ["d-0", "d-1", "d-2", "d-3"]
    key = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert all((r.shard, r.grown_shard) == (jump(key[r.doc_id], 16), jump(key[r.doc_id], 17)) for r in got)
    spans = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.repeat_digest(docs).collect()}
    by_number = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.repeat_digest(
        docs.withColumn("doc_id", F.substring("doc_id", 3, 9).cast("long"))).collect()}
    assert spans == {f"d-{k}": v for k, v in by_number.items()} and spans["d-0"][1] == len(text)


def test_slots_are_gapless_over_many_buckets(spark):
    rows = spark.range(5000).select(F.floor(F.col("id") / 3).alias("doc_id"), (F.col("id") % 4).cast("int").alias("shard"))
    got = sharding.number_slots(rows, rows_per_bucket=50).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(1250)) for s in slots.values())


# -- 2 repeated passages -----------------------------------------------------------------------
def brute_repeats(texts, depth):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + depth] for b in raw for i in range(len(b) - depth + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeats_equal_brute_force(spark, hot):
    texts = odd_texts()[:9] + odd_texts()[11:]
    rng = random.Random(2)
    passage = "".join(rng.choice("abc ") for _ in range(260))
    texts += ["".join(rng.choice("abcd ") for _ in range(rng.randrange(500))) + passage[rng.randrange(30):] +
              "".join(rng.choice("abcd ") for _ in range(rng.randrange(300))) for _ in range(12)]
    docs = frame(spark, texts, ids=[None, *range(1, len(texts) - 1), 1])
    got = repeats.repeat_digest(docs, hot_places=hot, shard_bytes=20_000).collect()
    want = brute_repeats(texts, 200)
    ids = [None, *range(1, len(texts) - 1), 1]
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for i, w in zip(ids, want))
    assert repeats.repeat_digest(docs.limit(0)).count() == 0


def test_remove_repeats_keeps_columns_and_valid_text(spark):
    shared = "é" * 150
    docs = frame(spark, [f"a{shared}b", f"cc{shared}", None, "short"])
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert got[0].text == "ab" and got[1].text == "cc" and got[2].text is None and got[3].text == "short"
    assert repeats.remove_repeats(docs).columns == docs.columns


def test_induced_sort_orders_suffixes():
    rng = np.random.default_rng(4)
    for k in range(400):
        n, depth = int(rng.integers(1, 150)), int(rng.integers(2, 30))
        t = rng.integers(97, 98 + int(rng.integers(1, 4)), n).astype(np.uint8)
        if k % 3 == 0:
            t[:] = np.resize(t[:int(rng.integers(1, 7))], n)
        budget, base = (100, 2) if k % 2 else (1 << 20, 1 << 20)       # with spills and recursion, and without
        assert list(induced_sort.Shard(t, 250, budget, base).order()) == sorted(range(n), key=lambda i: bytes(t[i:]))
        raw = bytes(t)
        seen = Counter(raw[i:i + depth] for i in range(n - depth + 1))
        want = [i + depth <= n and seen[raw[i:i + depth]] > 1 for i in range(n)]
        assert list(induced_sort.repeated_positions(t, depth, budget, base)) == want


# -- 3 SentencePiece ---------------------------------------------------------------------------
def test_sentencepiece_equals_the_library(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    with open(PIECE_FILE, "rb") as f:
        t = sentencepiece_fst.Transducer(f.read())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\x00", "▁", "a", "ß", "1", "²", "中", "!", "<s>", "<0x41>", "🎉", "́", "the", "ing",
             "a" * 9, "----", "\r\n", "    ", "한"]
    texts = [x or "" for x in odd_texts()] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for x in texts:
        ids = lib.encode(x)
        assert t.encode(x) == ids and t.decode(ids) == lib.decode(ids), x
    for _ in range(500):
        ids = [rng.randrange(600) for _ in range(rng.randrange(9))]
        assert t.decode(ids) == lib.decode(ids)
    docs = frame(spark, odd_texts())
    got = {r.doc_id: r for r in sentencepiece_fst.token_digest(docs, PIECE_FILE).collect()}
    for i, x in enumerate(odd_texts()):
        ids = lib.encode(x or "")
        assert got[i].n_tokens == len(ids) and got[i].round_trip
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    coded = sentencepiece_fst.encode_documents(docs, PIECE_FILE)
    assert coded.columns == [*docs.columns, "token_ids"]
    model = bpe_count.broadcast_file(spark, PIECE_FILE)
    back = coded.select("doc_id", sentencepiece_fst.decode(F.col("token_ids"), model).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: x or "" for i, x in enumerate(odd_texts())}
    assert sentencepiece_fst.token_digest(docs.limit(0), PIECE_FILE).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_fst.encode_documents(docs, PIECE_FILE, out_col="lang")


def _message(*fields):
    out = b""
    for no, value in fields:
        if isinstance(value, bytes):
            out += bytes([no << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            import struct
            out += bytes([no << 3 | 5]) + struct.pack("<f", value)
        else:
            out += (bytes([no << 3]) if no < 16 else bytes([(no << 3) & 127 | 128, no >> 4])) + bytes([value])
    return out


def test_unigram_shortest_path_equals_the_library():
    import sentencepiece
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.7, 1),
              ("ab", -3.1, 1), ("▁ab", -4.2, 1), ("abb", -6.0, 1), ("ba", -4.9, 1), ("▁a", -3.3, 1)]
    model = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    model += _message((2, _message((3, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    t = sentencepiece_fst.Transducer(model)
    rng = random.Random(3)
    for _ in range(500):
        x = "".join(rng.choice("aabb c") for _ in range(rng.randrange(12)))
        assert t.encode(x) == lib.encode(x), x


# -- 4 language id -----------------------------------------------------------------------------
def test_language_id_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    odd = frame(spark, [*odd_texts(), "123 456"], langs=["en" if i % 2 else "de" for i in range(len(odd_texts()))] + [None])
    rows = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert len(rows) == odd.count()
    for i in (0, 1, 2, len(odd_texts())):
        assert rows[i].lang_pred == "und" and rows[i].score == 0.0
    assert all(0.0 <= r.score <= 1.0 and r.lang_pred in ("en", "de", "und") for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = "The quick, brown fox! jumps 77 over the lazy dog " * 20
    whole = np.sort(np.concatenate(list(langid.buckets(text))))
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (np.sort(np.concatenate(list(langid.buckets(text)))) == whole).all()


# -- 5 quality ---------------------------------------------------------------------------------
def brute_quality(text):
    words = WORDS.findall(text or "")
    n = len(words)
    seen = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    rep = set()
    for i in range(n - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            rep.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep),
            n < 20 or 100 * len(rep) > 30 * n)


def test_quality_counts_equal_brute_force(spark, monkeypatch):
    docs = frame(spark, odd_texts())
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    for i, t in enumerate(odd_texts()):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert not (r.base_failed and r.kept)
    assert quality.score(docs.limit(0)).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_counts_do_not_depend_on_slices(monkeypatch):
    from lectern.llm import words
    whole = [brute_quality(t) for t in odd_texts()]
    monkeypatch.setattr(words, "SLICE", 64)
    for t, w in zip(odd_texts(), whole):
        d = quality.Doc((t or "").encode())
        assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed) == w


def test_cascade_order_is_by_rejections_per_cost_and_never_changes_the_verdict(spark):
    costs = [quality.RuleCost("dear", 1.0, 10, 100), quality.RuleCost("cheap", 0.01, 10, 100), quality.RuleCost("rare", 0.01, 0, 100)]
    assert quality.cascade_order(costs) == ["cheap", "rare", "dear"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [r.name for r in quality.RULES]
    a, b = (docs.select("doc_id", quality.quality_stats(F.col("text"), o).alias("q")).select("doc_id", "q.kept")
            for o in (names, names[::-1]))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


# -- 6 token counts ----------------------------------------------------------------------------
def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(BPE_FILE)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "a", "é", "1", "²", "中", "!", "'s", "'LL", "'ll", "<|endoftext|>",
             "_", "🎉", "́", "word", "½", "\x00"]
    texts = odd_texts() + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2000)]
    got = {r.doc_id: r for r in bpe_count.count_tokens(frame(spark, texts), BPE_FILE).collect()}
    for i, x in enumerate(texts):
        n = len(lib.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 512), x
    assert bpe_count.count_tokens(frame(spark, texts).limit(0), BPE_FILE).count() == 0


# -- 7 near duplicates -------------------------------------------------------------------------
def brute_groups(ids, texts, n_words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(lower))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n_words else [tuple(w[i:i + n_words]) for i in range(len(w) - n_words + 1)]))
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), low.get(find(i)) if sets[i] else ids[i]) for i in range(len(texts))]


def near_copies():
    rng = random.Random(9)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(150)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = odd_texts() + near_copies()
    ids = [None, *range(100, 99 + len(texts))]
    docs = frame(spark, texts, ids=ids)
    for n_words in (4, 5):
        got = minhash.near_duplicates(docs, n_words=n_words).collect()
        want = brute_groups(ids, texts, n_words, 80)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    one = minhash.keep_one(docs.union(docs))
    assert one.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in one.collect()) == sorted(
        i or -1 for i, _, c in brute_groups(ids, texts, 5, 80) if i == c)


def test_keep_one_goes_by_links_and_not_by_ids(spark):
    texts = [" ".join(f"t{d}w{i}" for i in range(60)) for d in range(7)]
    near = [t + " tail" for t in texts]
    rows = [(7, texts[0]), (7, texts[1]), (7, near[1]),                     # two unlinked texts under one id
            (None, texts[2]), (None, near[2]), (None, texts[3]), (None, texts[4]), (9, near[4]),
            (5, texts[5]), (None, texts[5]), (3, near[5]), (5, texts[6]),
            (None, None), (None, ""), (7, " \n"), (8, None), (8, None)]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    docs = docs.union(docs.where("doc_id = 8").limit(1).withColumn("lang", F.lit("de")))    # without words, not a repeated row
    got = Counter((r.doc_id, r.text.split("w")[0] if r.text else r.text, r.lang) for r in minhash.keep_one(docs).collect())
    assert got == Counter([(7, "t0", None), (7, "t1", None), (None, "t2", None), (None, "t3", None), (9, "t4", None),
                           (3, "t5", None), (5, "t6", None), (None, None, None), (None, "", None), (7, " \n", None),
                           (8, None, None), (8, None, "de")])


def test_unlinked_documents_that_share_a_passage_stay_apart(spark):
    shared = " ".join(f"common{i}" for i in range(60))
    texts = [shared + " " + " ".join(f"d{d}w{i}" for i in range(40)) for d in range(40)]
    got = minhash.near_duplicates(frame(spark, texts), n_words=4).collect()
    assert all(r.kept for r in got)


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 450)] + [(None, 3)]
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in links[:-1]:
        a, b = find(a), find(b)
        comp[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.label) for r in got} == {(x, find(x)) for x in list(comp)} and len(got) == len(comp)


# -- 8 chat ------------------------------------------------------------------------------------
CHAT = "conv_id long, turn long, role string, text string, block int"


def test_format_is_reversible():
    rng = random.Random(3)
    parts = ["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "<<SYS>>", "/SYS>>", "<|end|>", "<|turn|>", "\n", "a", "\\n"]
    for _ in range(5000):
        turns = [tuple("".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(2)) for _ in range(3)]
        text = "".join(chat.format_turn(*t)[0] for t in turns)
        assert chat.parse(text) == turns
        one, lo, hi = chat.format_turn(*turns[0])
        assert chat.unescape(one[lo:hi]) == turns[0][1]
        assert one.count(chat.OPEN) == 1 and "</s>" not in one and "[INST]" not in one


def test_chat_digest_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "hi <|end|>", "ünï\n</s>", "x" * 50]), 1)
            for c in range(20) for t in range(rng.randrange(1, 12))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}", 1) for t in range(400)]
    rows += [(51, 1, "user", "tie", 1), (51, 1, "assistant", "tie", 1), (51, 1, "assistant", "tie", 1), (51, None, "user", "first", 1),
             (None, 0, "user", "nobody", 1)]
    df = spark.createDataFrame(rows, CHAT)
    examples = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((-(1 << 62) if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.format_turn(r, x)[0]) for _, r, x in turns)
    full = chat.example_texts(examples).where("conv_id = 50").orderBy("block", "seq").collect()
    turns = by[50]
    assert len(full) == 200
    for k, e in enumerate(full):
        assert e.prompt == "".join(chat.format_turn(r, x)[0] for _, r, x in turns[:2 * k + 1])
        assert e.reply == chat.format_turn(*turns[2 * k + 1][1:])[0]
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_every_reply_is_an_example_with_its_whole_context(spark):
    rng = random.Random(18)
    rows = [(1, t, "assistant" if t % 3 else "user", "x" * rng.randrange(90), 1) for t in range(0, 400, 2)]
    rows += [(None, t, rng.choice(["user", "assistant"]), f"turn {t} </s>", 1) for t in (None, -70, 5, 5, 64, 1000)]
    rows += [(2, 0, "user", "no reply", 1), (2, 70, "system", "at all", 1), (3, 0, "assistant", "first", 1)]
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((-(1 << 62) if t is None else t, r, x))
    df = spark.createDataFrame(rows, CHAT)
    for piece in (chat.PIECE, 300):
        examples = chat.format_conversations(df, piece=piece)
        got = defaultdict(list)
        for r in sorted(examples.collect(), key=lambda r: (r.block, r.seq, r.piece)):
            at = got[r.conv_id]
            if r.piece == 0:
                at.append(["", None, r.whole])
            assert at[-1][1] is None and at[-1][2] == r.whole and len(r.context) < piece + 150
            at[-1][0] += r.context
            at[-1][1] = r.reply
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            text = [chat.format_turn(r, x)[0] for _, r, x in turns]
            want = [["".join(text[:i]), text[i], i == len(turns) - 1] for i, (_, r, _) in enumerate(turns) if r == "assistant"]
            if turns[-1][1] != "assistant":
                want.append(["".join(text), None, True])
            assert got[c] == want
        assert {r.conv_id: r.n_turns for r in chat.digest(examples).collect()} == {c: len(x) for c, x in by.items()}


# -- 9 mixing ----------------------------------------------------------------------------------
def test_rates_match_reachable_targets(spark):
    rng = random.Random(4)
    rows = [(i, i, i, rng.randrange(1, 400), [p, 1 - p]) for i in range(500) for p in [rng.choice([0.02, 0.5, 0.97])]]
    members = spark.createDataFrame(rows, "row long, doc_id long, h long, tokens long, p array<double>")
    have = [sum(r[3] * r[4][k] for r in rows) for k in (0, 1)]
    got = mixing.rates(members, ["a", "b"], {"a": 0.7, "b": 0.3}, budget=0.5 * min(have), steps=300, tolerance=1e-5).collect()
    assert all(0.0 <= r.rate <= 1.0 for r in got)
    for k, w in ((0, 0.7), (1, 0.3)):
        assert sum(r.rate * r.tokens * r.p[k] for r in got) == pytest.approx(0.5 * min(have) * w, rel=2e-2)


@pytest.mark.parametrize("targets", [{"good": 0.9, "plain": 0.1, "toxic": 0.0}, {"good": None, "plain": None, "toxic": 0.0}])
def test_rates_are_the_least_squares_solution_with_a_rare_domain(spark, targets):
    rng = np.random.default_rng(7)
    kind = rng.choice(3, 4000, p=[0.6, 0.399, 0.001])
    p = rng.dirichlet([0.05, 0.05, 1e-4], 4000) * 0.02 + np.eye(3)[kind] * 0.98
    tokens = rng.integers(0, 900, 4000)
    members = spark.createDataFrame([(i, i, i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))],
                                    "row long, doc_id long, h long, tokens long, p array<double>")
    rate = np.zeros(4000)
    for r in mixing.rates(members, ["good", "plain", "toxic"], targets).collect():
        rate[r.row] = r.rate
    assert rate.min() >= 0.0 and rate.max() <= 1.0
    have = tokens @ p
    want = have * [1, 1, 0] if targets["good"] is None else min(have[0] / 0.9, have[1] / 0.1) * np.array([0.9, 0.1, 0.0])
    assert 5e-4 < have[2] / have.sum() < 2e-3
    rest = ((rate * tokens) @ p - want) / have
    slope = p @ (rest / have)          # of the objective, a token; half the square of the distance from the best residuals
    assert (tokens * (slope * rate - np.minimum(slope, 0.0))).sum() <= 1e-3 ** 2 / 2      # is at most this (Frank-Wolfe) gap


def test_rates_that_are_not_reached_raise(spark):
    members = spark.createDataFrame([(0, 0, 0, 9, [0.5, 0.5]), (1, 1, 1, 5, [0.9, 0.1])],
                                    "row long, doc_id long, h long, tokens long, p array<double>")
    with pytest.raises(RuntimeError):
        mixing.rates(members, ["a", "b"], {"a": 0.9, "b": 0.1}, steps=1)


def test_mixing_drops_the_unwanted_domain_and_survives_odd_rows(spark):
    rng = random.Random(6)
    def text(bad):
        w = [f"n{rng.randrange(200)}" for _ in range(60)]
        return " ".join(w + (["nasty", "rude!"] if bad else ["kind"]))
    texts = [text(i % 5 == 0) for i in range(300)] + [None, "", " ,. ", "kind kind"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    mixed, domains = mixing.mix(docs, mixing.label_domains(labels), {"good": None, "plain": None, "toxic": 0.0})
    assert domains == ["good", "toxic"]
    rate = {r.doc_id: r for r in mixed.collect()}
    assert len(rate) == len(texts)
    assert all((rate[i].rate < 0.5) == (i % 5 == 0) for i in range(300))
    assert all(rate[i].tokens == 0 and rate[i].rate == 1.0 for i in (300, 301, 302)) and rate[303].tokens == 2
    kept = mixing.apply_rates(docs.union(docs.where("doc_id = 1")), mixed)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i in range(304) if i >= 300 or i % 5] + [1])
    nothing, none = mixing.mix(docs, mixing.label_domains(labels.limit(0)), {"good": 1.0})
    assert none == [] and {r.rate for r in nothing.collect()} == {1.0}
    assert mixing.mix(docs.limit(0), mixing.label_domains(labels), {"good": 1.0})[0].count() == 0


# -- 10 exact top-k ----------------------------------------------------------------------------
def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 12)).round(2)
    v[50:150] = v[50]                                         # ties
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)]
    rows += [(1000, None, "x"), (1001, [], "x"), (1002, [1.0, None] + [0.0] * 10, "x"), (1003, [float("nan")] * 12, "x"),
             (1020, [float("inf")] * 12, "x"), (1040, [1.0, 2.0], "x"), (1041, [3.0, -1.0], "x"), (None, [1.0] * 12, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in topk.exact_top_k(df, F.col("id") % 20 == 0, k=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    q = np.floor(64 * v).astype(np.int64)
    for i in range(0, 400, 20):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(400) if j != i)[:20]
        assert sorted(got[i]) == [(k + 1, j, -x) for k, (x, j) in enumerate(best)]
    assert got[1040] == [(1, 1041, 64 * 64 * 1)] and set(got) == {*range(0, 400, 20), 1040}
    assert topk.exact_top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_refuses_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e18, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(df, F.col("id") % 20 == 0).collect()
    with pytest.raises(OverflowError):
        topk.search(np.array([9]), np.array([[1 << 40, 1]]), np.arange(2), np.array([[1 << 40, 1], [1, 1]]), 2)


def test_top_k_with_values_beyond_double_precision():
    big = 1 << 29
    c = np.array([[big, 1], [big, 2], [big - 1, 3]], np.int64)
    q, v, s = topk.search(np.array([9]), np.array([[big, 1]], np.int64), np.arange(3), c, 2)
    assert list(v) == [1, 0] and list(s) == [big * big + 2, big * big + 1]


# -- whole tables ------------------------------------------------------------------------------
def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    docs, n = spark.read.parquet(f"{SF}/documents.parquet"), []
    cols = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        n.append(docs.count())
        if k < 4:
            assert docs.columns == cols
    want = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, want.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, docs.select("doc_id", "n_tokens").collect()))
    assert n == sorted(n, reverse=True) and n[-1] > 0
    raw = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert n[0] < len(raw) and n[1] < n[0]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_queries_return_the_contracted_columns(spark):
    from lectern.llm.queries import QUERIES
    want = {
        "op1": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
        "op2": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
        "op4": "doc_id:bigint held_out:boolean lang_pred:string score:double",
        "op5": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint "
               "base_failed:boolean kept:boolean",
        "op6": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
        "op7": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
        "op8": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
        "op10": "query_id:bigint rank:int vec_id:bigint score:bigint",
    }
    for name, query in QUERIES.items():
        kind = " ".join(f"{a}:{b}" for a, b in query(spark, SF).dtypes)
        if name.split("_")[0] in want:
            assert kind == want[name.split("_")[0]], name


def test_documents_schema_with_a_struct_column(spark):
    docs = frame(spark, ["kept text " + " ".join(f"w{i}" for i in range(40))]).withColumn("meta", F.struct(F.lit(1).alias("a")))
    assert quality.keep(docs).schema["meta"].dataType == T.StructType([T.StructField("a", T.IntegerType(), False)])
