"""The registered queries of this subpackage: thin ``opN_<name>`` wrappers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import (ball_codes, bpe_count, chat, langid, minhash, mixing, quality, repeats, sentencepiece_fst,
                         sharding, spelling, topk, vector_dedup)
from lectern.llm.common import load

TOKENIZERS = "/opt/tokenizers"


def op3(spark, sf_dir):
    return sentencepiece_fst.token_digest(load(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op4(spark, sf_dir):
    return langid.identify(load(spark, sf_dir, "documents"))


def op5(spark, sf_dir):
    return quality.score(load(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return bpe_count.count_tokens(load(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op7(spark, sf_dir):
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), n_words=4, percent=80)


def op10(spark, sf_dir):
    return topk.exact_top_k(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {
    "op1_jump_shards": sharding.op1,
    "op2_suffix_dedup": repeats.op2,
    "op3_sentencepiece": op3,
    "op4_language_id": op4,
    "op5_quality_rules": op5,
    "op6_token_counts": op6,
    "op7_minhash_dedup": op7,
    "op8_chat_format": chat.op8,
    "op9_soft_mixing": mixing.op9,
    "op10_va_top_k": op10,
    "op11_ball_codes": ball_codes.op11,
    "op12_subspace_dedup": vector_dedup.op12,
    "op13_spelling_trie": spelling.op13,
}



def _ball_rounds() -> str:
    """Three assignments with two renewals of the codebooks between them, as common table expressions."""
    out = ""
    for t in (1, 2, 3):
        out += f""",
a{t} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x,
         min([list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), i]) AS m
  FROM x JOIN b{t} USING (p) GROUP BY vec_id, p)"""
        if t < 3:
            out += f""",
n{t} AS (
  SELECT p, i, list(c ORDER BY j) AS c
  FROM (SELECT p, m[2] AS i, j, floor(sum(x[j]) / count(*)) AS c FROM a{t}, range(1, len(x) + 1) g(j) GROUP BY ALL) GROUP BY p, i),
b{t + 1} AS MATERIALIZED (SELECT p, i, coalesce(n{t}.c, b{t}.c) AS c FROM b{t} LEFT JOIN n{t} USING (p, i))"""
    return out


_WORD = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS w FROM d, range(1, len(ws) - 6) g(i) WHERE len(ws) >= 8),
rep AS (SELECT r, count(DISTINCT i + k) AS n
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win), range(0, 8) o(k) WHERE c > 1 GROUP BY r),
f AS (SELECT r, doc_id, t, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls,
             length(regexp_replace(t, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS letters,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS uppers, length(regexp_replace(t, '[^!?]', '', 'g')) AS bangs
      FROM d),
b AS (SELECT *, len(ls) - len(list_distinct(ls)) AS dups, coalesce(rep.n, 0) AS reps,
             n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS bad
      FROM f LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(dups AS BIGINT) AS n_dup_lines, CAST(reps AS BIGINT) AS n_repeat_words, bad AS base_failed,
       NOT bad AND NOT (n_symbols > 0.5 * n_words OR dups > 0.5 * len(ls) OR word_chars < 2 * n_words OR word_chars > 18 * n_words
            OR uppers > 0.6 * greatest(1, letters) OR bangs > 0.5 * n_words OR letters < 0.5 * word_chars) AS kept
FROM b""",
    "op7_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s
       FROM w, range(1, greatest(len(ws) - 2, 2)) g(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(root, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.root, b.b FROM reach r JOIN edge b ON r.seen = b.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT root AS doc_id, min(seen) AS component_id FROM reach GROUP BY root) c USING (doc_id)""",
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, len(regexp_extract_all(text, '(<<|[<\[])\\*(\||/?s>|/?INST\]|/?SYS>>)')) AS escapes FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>') + length(role) + 1 + length(text) + escapes + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_va_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op11_ball_codes": f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
x AS MATERIALIZED (SELECT vec_id, p, list_slice(e, p * len(e) // 16 + 1, (p + 1) * len(e) // 16) AS x FROM v, range(0, 16) g(p)),
b1 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS DOUBLE) AS i, x AS c FROM x QUALIFY i < 64){_ball_rounds()},
r AS (SELECT vec_id, string_agg(printf('%02x', CAST(m[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error
      FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda z: CAST(z AS BIGINT)), ','), ',' ORDER BY p, i)) FROM b3)
         AS codebooks_sha256
FROM r JOIN v USING (vec_id)""",
    "op12_subspace_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(root, seen) AS (SELECT a, a FROM link UNION SELECT r.root, l.b FROM reach r JOIN link l ON r.seen = l.a),
low AS (SELECT root, min(seen) AS m FROM reach GROUP BY root),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN low ON root = vec_id""",
    "op13_spelling_trie": r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(0, 256) g(i))),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
               CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + ord(x) // 64 AS BIGINT), CAST(128 + ord(x) % 64 AS BIGINT)] END))),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS k FROM words, range(1, length(word) + 1) g(i)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (i, k) WHERE a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON c.k = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON c.k = w.word),
best AS (SELECT word, count(*) AS n_near, min(-m) AS low FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -low >= 10 * w.n THEN -low END AS form_n,
             (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = -low AND -low >= 10 * w.n) AS form
      FROM words w LEFT JOIN best USING (word)),
walk(word, here, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN f ON f.word = k.here WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT max_by(here, step) FROM walk k WHERE k.word = f.word) AS root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f""",
}
