"""Operator 9: mixing sources to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier fitted on a labelled table predicts each document's domain
posteriors. Distributed projected gradient with implicit steps then solves the least-squares
problem for nonnegative document rates r: the expected tokens of domain d, sum_i r_i *
tokens_i * p_id, shall match the target of d. Every iteration is one aggregation of a few
sums for each pair of domains; the rates themselves never leave Spark.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, load, written

WORDS = r"[^\p{L}\p{N}]+"      # what stands between words (tokens)
BITS = 18                      # hash buckets of words: 2**BITS
TRAIN_ROWS = 20_000            # bound of the labelled sample the classifier is fitted on
MAX_DOMAINS = 64               # bound of the model's width
MAX_FEATURES = 4096            # bound of the broadcast model: the buckets with the largest deviation
DEVIATION = 5.0                # standard deviations a bucket's domain count must differ by


def words_of(text: Column) -> Column:
    """Runs of letters and digits of a text (null: none); the empty string stands where the text begins or ends in a separator."""
    return F.split(F.coalesce(text, F.lit("")), WORDS)


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(1 << BITS))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        domain_col: str = "domain", rows: int = TRAIN_ROWS) -> tuple[DataFrame | None, list[str], list[float]]:
    """Bernoulli naive Bayes over the hashed words that tell domains apart.

    Fitted on at most ``rows`` labelled documents, chosen by a hash of their id among all labels. Returns
    the feature table (bucket, w array: log-odds of presence per domain), the domains in order, and the
    base log-posterior of a document without any feature. Null ids, domains and texts take no part;
    without labels there are no domains.
    """
    names = labelled.select(F.col(id_col).alias("i"), F.col(domain_col).cast("string").alias("d")) \
                    .where("i IS NOT NULL AND d IS NOT NULL")
    some = names.dropDuplicates(["i"]).orderBy(F.xxhash64("i"), "i").limit(rows)
    train = written(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
                    .join(some, "i")
                    .select("d", F.explode(F.array_distinct(F.concat(
                        F.array(F.lit(-1).cast("long")),
                        F.transform(F.filter(words_of(F.col("t")), lambda w: w != ""), bucket)))).alias("b"))
                    .groupBy("d", "b").agg(F.count(F.lit(1)).alias("n")), "domain-words")
    size = {r.d: r.n for r in train.where("b = -1").limit(MAX_DOMAINS + 1).collect()}   # documents a domain
    if not size:
        return None, [], []
    if len(size) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains, total = sorted(size), sum(size.values())
    counts = train.where("b >= 0").groupBy("b").agg(
        *[F.coalesce(F.sum(F.when(F.col("d") == d, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, d in enumerate(domains)])
    every = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))
    off = F.greatest(F.lit(0.0), *[F.abs(F.col(f"n{k}") - every * size[d] / total) / F.sqrt(every * size[d] / total)
                                   for k, d in enumerate(domains)])
    p = [(F.col(f"n{k}") + 0.5) / (size[d] + 1.0) for k, d in enumerate(domains)]
    table = written(counts.withColumn("off", off).where((F.col("off") >= DEVIATION) & (every >= 5))
                    .orderBy(F.desc("off"), "b").limit(MAX_FEATURES)
                    .select("b", F.array(*[F.log(x) - F.log1p(-x) for x in p]).alias("w"),
                            F.array(*[F.log1p(-x) for x in p]).alias("absent")), "domain-model")
    zero = table.agg(*[F.coalesce(F.sum(F.col("absent")[k]), F.lit(0.0)).alias(f"z{k}")
                       for k in range(len(domains))]).first()
    base = [math.log(size[d] / total) + zero[k] for k, d in enumerate(domains)]
    discard(train)
    return table.select("b", "w"), domains, base


def posteriors(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, h, tokens, p): a row for each row of ``docs``, with a hash of the text, its number of
    words and the posterior of each domain. A null or empty text has no tokens and the base posterior.
    The exploded words meet the bounded feature table in a broadcast join and are summed per row before
    the shuffle, so a text of any length costs one row there."""
    table, domains, base = model
    w = words_of(F.col(text_col))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                    text_key(F.col(text_col)).alias("h"), w.alias("ws"))
    n = len(domains)
    x = d.select("row", "doc_id", "h",
                 _count(F.col("ws")).alias("tokens"),
                 F.explode(F.array_distinct("ws")).alias("word"))
    hit = x.withColumn("b", F.when(F.col("word") != "", bucket(F.col("word"))))
    joined = hit.join(F.broadcast(table), "b", "left")
    got = joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("tokens").alias("tokens"),
        *[F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n)])
    logit = [F.col(f"s{k}") + F.lit(base[k]) for k in range(n)]
    top = F.greatest(*logit) if n > 1 else logit[0]
    e = [F.exp(x - top) for x in logit]
    total = sum(e[1:], e[0])
    return got.select("row", "doc_id", "h", "tokens", F.array(*[x / total for x in e]).alias("p"))


def _count(ws: Column) -> Column:
    """Words of a split text: its parts without the empty ones, which stand only at either end."""
    empty = lambda at: F.when(F.element_at(ws, at) == "", 1).otherwise(0)
    return (F.size(ws) - empty(1) - F.when(F.size(ws) > 1, empty(-1)).otherwise(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def rates(members: DataFrame, domains: list[str], targets: dict[str, float | None], max_rate: float = 1.0,
          steps: int = 1000, tolerance: float = 1e-4, budget: float | None = None) -> DataFrame:
    """``members`` plus ``rate`` in [0, max_rate].

    ``targets`` gives each domain's weight; None stands for the domain's own tokens (leave it as it is)
    and a domain that is not named has weight 0. Weights share ``budget`` tokens; without one, the largest
    budget that asks no weighted domain for more than ``max_rate`` times its expected tokens.
    Residuals are relative to a domain's tokens, and a step is taken in the metric of a document's tokens,
    in which the projection onto the box stays exact. The step is implicit: the rates are the projection of
    rate 1 less ``length`` times the gradient at these rates themselves, so a rare domain does not slow it.
    One number a domain (``z``) tells all rates; it is found by Newton's method, one aggregation a trial, and
    ``length`` grows tenfold until the duality gap proves each domain's residual within ``tolerance`` of the
    constrained least-squares solution. More than ``steps`` aggregations raise an error. Documents without
    tokens keep rate 1 (at most ``max_rate``).
    """
    n, start, top = len(domains), min(1.0, max_rate), float(max_rate)
    if not n:
        return members.withColumn("rate", F.lit(start))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    p = [F.col("p")[k] for k in range(n)]
    sums = members.agg(*[total(F.col("tokens") * p[k]).alias(f"s{k}") for k in range(n)]).first()
    have = np.array([sums[f"s{k}"] for k in range(n)])
    weight = [targets.get(d, 0.0) for d in domains]
    named = [(have[k], weight[k]) for k in range(n) if weight[k]]
    if budget is None:
        all_named = sum(w for _, w in named) or 1.0
        budget = min((max_rate * h * all_named / w for h, w in named), default=0.0)
    share = sum(w for _, w in named) or 1.0
    want = np.array([have[k] if weight[k] is None else budget * weight[k] / share for k in range(n)])
    scale = np.maximum(have, 1.0)
    length = 100.0 * max(float(have.sum()), 1.0)

    def shift(z: np.ndarray) -> Column:
        return sum((p[k] * float(z[k]) for k in range(1, n)), p[0] * float(z[0]))

    def clip(u: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(top), F.lit(start) - u))

    def at(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Sums over documents at ``z``: tokens of the domains, their Gram matrix of the documents whose rate can
        move, half the squared way from the start, and the negative part of the gradients."""
        t, u, r, q = F.col("tokens"), F.col("u"), F.col("r"), [F.col(f"q{k}") for k in range(n)]
        free = F.when((u < start) & (u >= start - top), t).otherwise(0)
        got = (members.select("tokens", shift(z).alias("u"), *[p[k].alias(f"q{k}") for k in range(n)])
               .withColumn("r", clip(u))
               .agg(*[total(r * t * q[k]).alias(f"s{k}") for k in range(n)],
                    *[total(free * q[j] * q[k]).alias(f"g{j}_{k}") for j in range(n) for k in range(j + 1)],
                    total(t * (r - start) * (r - start) * 0.5).alias("way"),
                    total(t * F.least(u, F.lit(0.0))).alias("low")).first())
        return (np.array([got[f"s{k}"] for k in range(n)]),
                np.array([[got[f"g{max(j, k)}_{min(j, k)}"] for k in range(n)] for j in range(n)]), got["way"], got["low"])

    def value(z: np.ndarray, sums: tuple) -> tuple[float, np.ndarray]:
        """The convex function whose minimum is sought, and its gradient."""
        reached, _, way, _ = sums
        return (0.5 * float(((scale * z) ** 2).sum()) / length + float((want - reached) @ z) - way,
                scale * scale * z / length + want - reached)

    z = np.zeros(n)
    now, used = at(z), 1
    while True:
        phi, slope = value(z, now)
        dual = (top * now[3] - float(z @ want)) / length - 0.5 * float(((scale * z / length) ** 2).sum())
        gap = 0.5 * float((((now[0] - want) / scale) ** 2).sum()) - dual
        if math.sqrt(2.0 * max(gap, 0.0)) <= tolerance:      # bounds every domain's distance from its best residual
            return members.withColumn("rate", F.when(F.col("tokens") > 0, clip(shift(z))).otherwise(F.lit(start)))
        if float(np.abs(slope / scale).max()) <= 0.01 * tolerance:
            length *= 10.0
            continue
        newton = -np.linalg.solve(now[1] / np.outer(scale, scale) + np.eye(n) / length, slope / scale) / scale
        part = 1.0
        while True:
            if used >= steps:
                raise RuntimeError(f"rates not within {tolerance} of the solution after {steps} aggregations")
            trial, used = at(z + part * newton), used + 1
            higher, steep = value(z + part * newton, trial)
            if float(steep @ newton) <= 0.0 or higher <= phi + 1e-4 * part * float(slope @ newton):
                break
            part *= 0.5
        z, now = z + part * newton, trial


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float | None], max_rate: float = 1.0,
        id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> tuple[DataFrame, list[str]]:
    """(doc_id, h, tokens, p, rate) of every row of ``docs``, and the domains in the order of ``p``. Repeated rows get
    a row each; an empty table, an empty label table and a label table of one domain are allowed."""
    model = fit(docs, labelled, id_col, text_col, domain_col)
    if not model[1]:
        members = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                              text_key(F.col(text_col)).alias("h"), _count(words_of(F.col(text_col))).alias("tokens"),
                              F.array().cast("array<double>").alias("p"))
        return rates(members, [], targets, max_rate).drop("row"), []
    members = written(posteriors(docs, model, id_col, text_col), "members")
    return rates(members, model[1], targets, max_rate).drop("row"), model[1]


def apply_rates(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated round(rate) times (0: the row goes), with its own columns only."""
    copies = (mixed.groupBy("doc_id", "h").agg(F.max("rate").alias("rate"))
              .select(F.col("doc_id").alias("__i"), F.col("h").alias("__h"),
                      F.floor(F.col("rate") + 0.5).cast("int").alias("__c")).where("__c > 0"))
    rows = docs.select(F.col(id_col).alias("__id"), text_key(F.col(text_col)).alias("__th"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    out = rows.join(copies, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__h")))
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__c")))).select("__row.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the label table: toxic, else good or plain by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
                         .otherwise("plain").alias("domain"))


def op9(spark, sf_dir):
    mixed, domains = mix(load(spark, sf_dir, "documents"), label_domains(load(spark, sf_dir, "labels")),
                         {"good": 0.9, "plain": 0.1, "toxic": 0.0})
    post = [F.round(F.col("p")[k], 6).alias(f"p_{d}") for k, d in enumerate(domains)]
    return mixed.select("doc_id", F.col("tokens").alias("n_tokens"), *post, F.round("rate", 6).alias("rate"))
