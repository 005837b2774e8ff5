"""Operator 13: spelling variants grouped by a frequency-vector trie.

The letters fall into groups; a word's frequency vector counts its letters by group. Words that differ by one
inserted, deleted or replaced code point have vectors that differ by a surplus of at most one and a deficit of
at most one. The trie's levels are the groups in order, its edges the counts and its leaves the words of one
vector. A search goes down depth first with a budget of one surplus and one deficit; the words of the leaves it
reaches are verified.

The first ``TOP`` levels are the partitioning: a word lives in the subtree of its first counts and asks the
subtrees that the budgets reach (at most 1 + 2 * TOP + TOP * (TOP - 1)), each unordered pair of subtrees from one side. Subtrees are
cut into chunks of about HOME words and their askers into groups of about ASK, so that a crowded subtree is many
tasks; each task builds the trie of its chunk's lower levels, and its
askers search it together. Found pairs are
rows; a word meets at most a few hundred others, whatever the size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, join_counted, load, written

GROUPS = 12               # letter groups: levels of the trie
TOP = 4                   # levels that name a subtree
HOME = 20_000             # words a chunk, about
ASK = 100_000             # askers a group, about
TASK = 20_000             # words and questions a task, about
MIN_LENGTH, MIN_COUNT, DROP, RATIO = 7, 2, 31, 10
#: Fixed by the contract: what a run of letters is.
LETTERS = "A-Za-zÀ-ÿ"


def variant_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  drop: int = DROP) -> DataFrame:
    """Rows (word, n) of all texts: maximal runs of letters, A-Z lower-cased, of at least ``min_length`` code points.

    Where ``drop`` divides h, the CRC-32 of "<id>:<run>", the code point at h modulo the length is left out before
    the length counts (a null id is the empty string). Null texts have no words. Counts are combined before the
    shuffle, so a word that fills the corpus costs a row a task.
    """
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), found.alias("run"))
    runs = runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    h = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.pmod("h", F.lit(drop)) == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
                  ).otherwise(F.col("run"))
    return (h.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def group_of(groups: int = GROUPS) -> dict[int, int]:
    """Letter group of every code point: letters are dealt in the order of the alphabet, other code points by number."""
    return {c: (c - 97 if 97 <= c < 123 else c) % groups for c in range(256)}


def frequency_vectors(words: list[str], groups: int = GROUPS) -> np.ndarray:
    """(n, groups) counts of the letters of each group."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    table = np.array([group_of(groups)[c] for c in range(256)])
    g = np.where(flat < 256, table[np.minimum(flat, 255)], flat % groups)
    return np.bincount(np.repeat(np.arange(len(words)), size) * groups + g, minlength=len(words) * groups).reshape(len(words), groups)


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i + (len(short) == len(long)):] == long[i + 1:]


def ends(words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last ``k`` (at most 3) code points of each word, packed into a number."""
    out = []
    for part in ([w[:k] for w in words], [w[len(w) - k:] for w in words]):
        flat = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(words), k)
        out.append(sum((flat[:, i] << (21 * i) for i in range(k)), np.zeros(len(words), np.int64)))
    return out[0], out[1]


class Trie:
    """Words by successive group counts, held as nested dictionaries; a leaf is a list of word numbers."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.root: dict = {}
        self.last = vectors.shape[1] - 1
        for i, vector in enumerate(vectors.tolist()):
            node = self.root
            for c in vector[:-1]:
                node = node.setdefault(c, {})
            node.setdefault(vector[-1], []).append(i)

    def search(self, vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
        """(askers, words of a leaf) for each leaf whose counts exceed an asker's vector by at most ``surplus`` and
        fall short of it by at most ``deficit``, in sum. All askers go down together, depth first; each is left
        behind at the first edge beyond its budget."""
        stack = [(self.root, 0, np.arange(len(vectors)), surplus, deficit)]
        while stack:
            node, level, who, more, less = stack.pop()
            count = vectors[who, level]
            for c, child in node.items():
                step = c - count
                go = np.flatnonzero((step <= more) & (-step <= less))
                if not len(go):
                    continue
                if level == self.last:
                    yield who[go], child
                else:
                    spent = step[go]
                    stack.append((child, level + 1, who[go], more[go] - np.maximum(spent, 0), less[go] - np.maximum(-spent, 0)))


def near_words(words: list[str], homes: int, vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray,
               own: bool) -> Iterator[tuple[int, int]]:
    """Pairs (asker, home), as word numbers, that are one edit apart. The first ``homes`` words are at home; with
    ``own`` they ask too, for words that come after them.

    Of the words of a leaf only those with the asker's first or last code points are verified: half of the
    shorter word on one side of an edit is left as it was.
    """
    k = min(3, min(map(len, words)) // 2)
    first, last = ends(words, k)
    trie = Trie(vectors[:homes])
    start = 0 if own else homes
    for who, leaf in trie.search(vectors[start:], surplus[start:], deficit[start:]):
        who, leaf = who + start, np.array(leaf)
        for at in range(0, len(who), max(1, (1 << 20) // len(leaf))):
            some = who[at:at + max(1, (1 << 20) // len(leaf))]
            i, j = np.nonzero((first[some][:, None] == first[leaf]) | (last[some][:, None] == last[leaf]))
            for x, y in zip(some[i].tolist(), leaf[j].tolist()):
                if (x >= homes or words[y] > words[x]) and one_edit(words[x], words[y]):
                    yield x, y


def reachable(top: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """(other subtree, surplus left, deficit left) a word of the subtree ``top`` must ask; the subtree itself first,
    then only those that come after it in order."""
    yield top, 1, 1
    n = len(top)
    for i in range(n):
        up = top[:i] + (top[i] + 1,) + top[i + 1:]
        if up > top:
            yield up, 0, 1
        if top[i] == 0:
            continue
        down = top[:i] + (top[i] - 1,) + top[i + 1:]
        if down > top:
            yield down, 1, 0
        for j in range(n):
            if j != i:
                both = down[:j] + (down[j] + 1,) + down[j + 1:]
                if both > top:
                    yield both, 0, 0


def _place(groups: int, top: int):
    """mapInArrow: words to (word, n, vec, home subtree, asked subtrees with their budgets)."""

    def name(t) -> str:
        return ".".join(map(str, t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            vec = frequency_vectors(words, groups)
            home, asks = [], []
            memo: dict[tuple, list] = {}
            for t in map(tuple, vec[:, :top].tolist()):
                if t not in memo:
                    memo[t] = [{"tree": name(o), "more": m, "less": s} for o, m, s in reachable(t)]
                asks.append(memo[t][1:])
                home.append(memo[t][0]["tree"])
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * (groups - top)),
                                          pa.array(vec[:, top:].ravel().astype(np.int32))),
                 pa.array(home, pa.string()),
                 pa.array(asks, pa.list_(pa.struct([("tree", pa.string()), ("more", pa.int32()), ("less", pa.int32())])))],
                names=["word", "n", "vec", "home", "asks"])

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, chunk, grp, kind), words at home first: near pairs, once each."""
    unit, key = [], None

    def finish() -> Iterator[pa.RecordBatch]:
        if not unit:
            return
        words = [w for part in unit for w in part[0]]
        n, vec, kind, more, less = (np.concatenate([part[i] for part in unit]) for i in range(1, 6))
        unit.clear()
        a, b = [], []

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([words[i] for i in a], pa.string()), pa.array(n[a], pa.int64()),
                                              pa.array([words[i] for i in b], pa.string()), pa.array(n[b], pa.int64())],
                                             names=["a", "an", "b", "bn"])
            a.clear(), b.clear()
            return out

        for x, y in near_words(words, int((kind == 0).sum()), vec, more, less, key[2] == 0):
            a.append(x)
            b.append(y)
            if len(a) >= 10_000:
                yield found()
        if a:
            yield found()

    for batch in batches:
        words, trees = batch.column("word").to_pylist(), batch.column("tree").to_pylist()
        n, chunk, grp, kind, more, less = (batch.column(c).to_numpy() for c in ("n", "chunk", "grp", "kind", "more", "less"))
        vec = batch.column("vec").flatten().to_numpy().reshape(len(words), -1)
        keys = list(zip(trees, chunk.tolist(), grp.tolist()))
        at = 0
        while at < len(keys):
            if keys[at] != key:
                yield from finish()
                key = keys[at]
            to = at + 1
            while to < len(keys) and keys[to] == key:
                to += 1
            unit.append((words[at:to], n[at:to], vec[at:to], kind[at:to], more[at:to], less[at:to]))
            at = to
    yield from finish()


def near_pairs(words: DataFrame, groups: int = GROUPS, top: int = TOP) -> DataFrame:
    """(a, an, b, bn): every unordered pair of distinct words of ``words`` (word, n; each word once) that one edit apart, once."""
    placed = written(words.mapInArrow(_place(groups, top), "word string, n long, vec array<int>, home string, "
                                      "asks array<struct<tree:string,more:int,less:int>>"), "words")
    sizes = placed.select(F.col("home").alias("tree"), F.lit(1).alias("h"), F.lit(0).alias("a")).unionByName(
        placed.select(F.explode("asks.tree").alias("tree"), F.lit(0).alias("h"), F.lit(1).alias("a")))
    units = written(sizes.groupBy("tree").agg(F.sum("h").alias("h"), F.sum("a").alias("a")).where("h > 0")
                    .select("tree", "h", "a", F.ceil(F.col("h") / HOME).cast("int").alias("chunks"),
                            F.ceil((F.col("h") + F.col("a")) / ASK).cast("int").alias("grps")), "subtrees")

    work = units.agg(F.sum(F.col("h") * F.col("grps") + (F.col("h") + F.col("a")) * F.col("chunks"))).first()[0] or 1
    tasks = min(100_000, -(-int(work) // TASK))

    def of_units(rows: DataFrame, n: str) -> DataFrame:
        return join_counted(rows, units.select("tree", "chunks", "grps", F.col(n).alias("_n")), ["tree"], "_n")

    def spread(n: str, salt: int):
        return F.pmod(F.xxhash64("word", F.lit(salt)), F.col(n)).cast("int")

    out = ["word", "n", "vec", "tree", "chunk", "grp", "kind", "more", "less"]
    one, zero = F.lit(1), F.lit(0)
    home = of_units(placed.withColumnRenamed("home", "tree"), "h").withColumn("chunk", spread("chunks", 1))
    homes = home.withColumn("grp", F.explode(F.sequence(zero, F.col("grps") - 1))).withColumn("kind", zero)
    later = (home.where("chunk + 1 < chunks").withColumn("grp", spread("grps", 2)).withColumn("kind", one)
             .withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1))))
    asks = (of_units(placed.select("word", "n", "vec", F.explode("asks").alias("q")).select("word", "n", "vec", "q.*"), "a")
            .withColumn("grp", spread("grps", 2)).withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1))).withColumn("kind", one))
    rows = (homes.withColumns({"more": one, "less": one}).select(*out)
            .unionByName(later.withColumns({"more": one, "less": one}).select(*out)).unionByName(asks.select(*out)))
    found = written(rows.repartition(tasks, "tree", "chunk", "grp").sortWithinPartitions("tree", "chunk", "grp", "kind")
                    .mapInArrow(_search, "a string, an long, b string, bn long"), "pairs")
    discard(placed)
    return found


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH,
                    min_count: int = MIN_COUNT, drop: int = DROP, ratio: int = RATIO) -> DataFrame:
    """One row a word with at least ``min_count`` occurrences: word, form, root, n, n_near, form_n.

    Words are near if one edit apart; a word's form is its near word of largest n (ties to the smallest in code
    point order) if that is at least ``ratio`` times its own, else null; root follows the forms to the last.
    Null and empty texts have no words; an empty table gives no rows. Very long words are words like others.
    """
    words = written(variant_words(docs, id_col, text_col, min_length, drop).where(F.col("n") >= min_count), "vocabulary")
    pairs = near_pairs(words)
    best = F.struct(-F.col("bn"), F.col("b").alias("w"), F.col("bn"))
    near = (pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
            .groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best")))
    rows = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.bn") >= ratio * F.col("n"), F.col("best.w")).alias("form"),
        F.when(F.col("best.bn") >= ratio * F.col("n"), F.col("best.bn")).alias("form_n")), "forms")
    return rows.join(_roots(rows.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form; the way is halved each round, and n grows by the ratio at each
    step of it, so a handful of rounds do."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new.select("word", "root")
        now._written_path = new._written_path
        if not new.where("moved").limit(1).count():
            return now


def op13(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all ``documents``."""
    return spelling_groups(load(spark, sf_dir, "documents"))
