"""Toxicity by maximum-scoring segments.

Words get log-odds under Dirichlet priors, from a bounded sample of labelled documents. A
document is a sequence of such scores; one linear scan finds every maximal segment whose sum
beats all that could extend it. Segment scores are judged by extreme-value statistics: with the
words of clean documents as background, the best segment of n words exceeds s by chance with
probability 1 - exp(-K n exp(-lambda s)). The significance of a document's segments is turned
into a probability by cross-fitting: each labelled document is judged by scores learned without
its fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm.common import forget, release, releasing, saved, table

WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


@dataclass(frozen=True)
class Training:
    """documents: bound of the fit, as labelled documents used (chosen by hash). percent: share of
    word triples from which two of them are copies. prefixes: lengths of the word beginnings that
    are features besides whole words. prior and flat: the Dirichlet prior of a feature, in
    documents, as prior times its overall share plus flat. clear: roots of the likelihood ratio,
    of which cross-fitting chooses the least that a feature must have; the highest is enough for
    a million features by chance. gap: score of a word without features."""

    documents: int = 20_000
    percent: int = 80
    prefixes: tuple[int, ...] = (4, 5, 6)
    prior: float = 1.0
    flat: float = 0.5
    clear: tuple[float, ...] = (3.0, 3.5, 4.0, 4.7)
    gap: float = -0.25


@dataclass(frozen=True)
class Model:
    """scores: log-odds by word, or by beginning, written with a leading ~; other words get
    `rest`. steepness and spread are lambda and log K of the extreme-value law. a, b: the
    probability is 1 / (1 + exp(-(a + b x))) of a document's significance x."""

    scores: dict[str, float]
    prefixes: tuple[int, ...]
    rest: float
    steepness: float
    spread: float
    a: float
    b: float


# Smallest hashes by which copies are told.
SIGNS = 16
# Words remembered per task and model.
MEMO = 300_000


def segments(scores: list[float], at: list[int], gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last), by a single scan.

    scores[i] is the score of position at[i]; every other position has the score gap < 0, so
    only listed positions are visited. A stack holds the candidate segments with the running
    totals before and after each.
    """
    stack: list[tuple[float, float, int, int]] = []  # total before, total after, first, last
    total, before = 0.0, -1
    for score, here in zip(scores, at, strict=True):
        total += gap * (here - before - 1)
        before = here
        if score <= 0:
            total += score
            continue
        left, right, first = total, total + score, here
        total = right
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k -= 1
            if k < 0 or stack[k][1] >= right:
                break
            left, first = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((left, right, first, here))
    return [(right - left, first, last) for left, right, first, last in stack]


def features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    return [word, *("~" + word[:n] for n in prefixes if len(word) > n)]


def lookup(model: Model, word: str) -> float | None:
    """The strongest score of the word and its beginnings."""
    scores = model.scores
    best = scores.get(word)
    for n in model.prefixes:
        if len(word) > n:
            other = scores.get("~" + word[:n])
            if other is not None and (best is None or abs(other) > abs(best)):
                best = other
    return best


def passages(text: str | None, model: Model, memo: dict) -> tuple[int, list[tuple[float, int, int]]]:
    """Words in the text, and its maximal segments in word positions."""
    found = WORD.findall((text or "").lower())
    scores, at = [], []
    for i, word in enumerate(found):
        score = memo.get(word, memo)
        if score is memo:
            if len(memo) > MEMO:
                memo.clear()
            score = memo[word] = lookup(model, word)
        if score is not None:
            scores.append(score)
            at.append(i)
    return len(found), segments(scores, at, model.rest)


def significance(n: int, found: list[tuple[float, int, int]], model: Model) -> float:
    """-log of the chance that clean text of n words holds such segments: each segment beyond
    its expected number under the extreme-value law adds its excess."""
    level = model.spread + math.log(max(n, 1))
    return sum(max(0.0, model.steepness * s - level) for s, _, _ in found)


def probability(x: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, model.a + model.b * x))))


def remainder() -> Column:
    """crc32 of the id as text, mod 4; 2 marks held-out rows. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(-1))


def _count(batches: Iterator[pd.DataFrame], prefixes: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    """Per batch and fold: how many clean and toxic documents hold each feature, and uses of it in
    clean ones. The row with an empty feature counts the documents and clean words themselves."""
    forget()
    for batch in releasing(batches):
        for fold, part in batch.groupby("fold"):
            docs, uses = (Counter(), Counter()), Counter()
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                words = Counter(WORD.findall((text or "").lower()))
                held = {f for w in words for f in features(w, prefixes)}
                docs[toxic].update(held)
                docs[toxic][""] += 1
                if not toxic:
                    uses.update(words)
                    uses[""] += words.total()
            found = list(docs[0].keys() | docs[1].keys())
            yield pd.DataFrame(
                {
                    "fold": int(fold),
                    "feature": found,
                    "docs0": [docs[0][f] for f in found],
                    "docs1": [docs[1][f] for f in found],
                    "uses0": [uses[f] for f in found],
                }
            )


def _triples(text: str | None) -> list[int]:
    words = [crc32(w.encode()) for w in WORD.findall((text or "").lower())]
    found = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
    return [hash(t) for t in found]


def _marks(text: Column) -> Column:
    """The smallest word triple of a text under two hashes, as a struct of a and b."""

    @F.pandas_udf("a long, b long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        forget()
        mixed = [_triples(t) for t in texts]
        release()
        return pd.DataFrame(
            [(min(m), min(x * 0x9E3779B97F4A7C15 & (1 << 63) - 1 for x in m)) for m in mixed], columns=["a", "b"]
        )

    return marks(text)


def _without_copies(used: DataFrame, mark: str, percent: int) -> DataFrame:
    """One row for each group of copies among those that share a mark: that of the smallest id, as
    toxic if any of them is. A row is a copy of the first kept row with enough of its triples, so
    unlike texts that share the mark all stay, and the order of rows plays no part. Only rows that
    agree in half of SIGNS smallest hashes are compared: copies do all but once in ten thousand
    times. A group is at most the labelled documents of the fit."""
    keys = np.random.default_rng(5).integers(0, 1 << 63, SIGNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
        kept: list[tuple[int, np.ndarray]] = []
        signs = np.empty((len(rows), SIGNS), dtype=np.uint64)
        toxic = rows["toxic"].tolist()
        for i, text in enumerate(rows["text"]):
            own = np.unique(np.array(_triples(text), dtype=np.int64).view(np.uint64))
            sign = (own * keys[:, None]).min(axis=1)
            for k in np.flatnonzero((signs[: len(kept)] == sign).sum(axis=1) >= SIGNS // 2).tolist():
                j, other = kept[k]
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    toxic[j] = max(toxic[j], toxic[i])
                    break
            else:
                signs[len(kept)] = sign
                kept.append((i, own))
        at = [i for i, _ in kept]
        return rows.loc[at].assign(toxic=[toxic[i] for i in at])

    return used.groupBy(mark).applyInPandas(merge, used.schema)


def _likelihood(name: str, n: float, share: Column | None = None) -> Column:
    """Log-likelihood of the count under a share of documents, its own if none is given."""
    count = F.col(name)
    share = count / F.lit(n) if share is None else share
    hit = F.when(count > 0, count * F.log(share)).otherwise(0.0)
    return hit + F.when(count < n, (F.lit(n) - count) * F.log(F.lit(1.0) - share)).otherwise(0.0)


def _lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1."""
    low, high = 0.0, 1.0
    f = lambda x: float(np.sum(shares * np.exp(np.minimum(x * values, 500.0)))) - 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps on a + b x with a weak pull to zero."""
    p = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    pull = np.diag([1e-3, 1e-3])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]) + pull, design.T @ (y - q) - pull @ p)
        p = p + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(max(p[1], 0.0))


EMPTY = Model({}, (), -1.0, 1.0, 0.0, -3.0, 0.0)


def _fits(counted: DataFrame, how: Training) -> list[Model] | None:
    """A model for each of how.clear, without law and probability; None if one kind is missing."""
    totals = counted.where("feature = ''").first()
    if totals is None or not totals["docs0"] or not totals["docs1"]:
        return None
    n0, n1 = float(totals["docs0"]), float(totals["docs1"])
    share = (F.col("docs0") + F.col("docs1")) / F.lit(n0 + n1)
    y0, y1 = (F.col(n) + share * how.prior + how.flat for n in ("docs0", "docs1"))
    more = how.prior + 2 * how.flat
    odds = F.log(y1 / (n1 + more - y1)) - F.log(y0 / (n0 + more - y0))
    error = F.sqrt(1.0 / y1 + 1.0 / y0)
    split = _likelihood("docs0", n0) + _likelihood("docs1", n1)
    both = _likelihood("docs0", n0, share) + _likelihood("docs1", n1, share)
    listed = (
        counted.where("feature <> '' and docs0 + docs1 > 0")
        .select("feature", "uses0", odds.alias("score"), error.alias("error"), (2 * (split - both)).alias("ratio"))
        .where((F.col("ratio") >= min(how.clear) ** 2) & (F.abs("score") > F.col("error")))
        .collect()
    )
    listed.sort(key=lambda r: (-r["ratio"], r["feature"]))
    out = []
    for clear in how.clear:
        kept = [r for r in listed if r["ratio"] >= clear**2]
        # A score shrinks by its own error, so features seen a few times say little.
        scores = {r["feature"]: math.copysign(abs(r["score"]) - r["error"], r["score"]) for r in kept}
        words = [r for r in kept if r["feature"][0] != "~"]
        uses = np.array([r["uses0"] + how.flat for r in words])
        values = np.array([*(scores[r["feature"]] for r in words), how.gap])
        shares = np.append(uses, max(float(totals["uses0"]) - uses.sum(), 1.0))
        out.append(Model(scores, how.prefixes, how.gap, _lambda(values, shares / shares.sum()), 0.0, 0.0, 1.0))
    return out


def _judged(rows: DataFrame, models: list[Model], measure) -> list:
    """(toxic, n words, measure(words, segments, model) for each model) of all rows."""

    @F.pandas_udf("n long, value array<double>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        memo: dict[str, tuple] = {}  # which models score a word, and how
        out = []
        for text in texts:
            words = WORD.findall((text or "").lower())
            scores: list[list[float]] = [[] for _ in models]
            at: list[list[int]] = [[] for _ in models]
            for i, word in enumerate(words):
                known = memo.get(word)
                if known is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    own = ((k, lookup(model, word)) for k, model in enumerate(models))
                    known = memo[word] = tuple((k, s) for k, s in own if s is not None)
                for k, s in known:
                    scores[k].append(s)
                    at[k].append(i)
            found = [segments(s, p, m.rest) for s, p, m in zip(scores, at, models, strict=True)]
            out.append((len(words), [float(measure(len(words), f, m)) for f, m in zip(found, models, strict=True)]))
        memo.clear()
        release()
        return pd.DataFrame(out, columns=["n", "value"])

    return rows.select("toxic", scan("text").alias("s")).select("toxic", "s.*").collect()


def _loss(x: np.ndarray, y: np.ndarray, a: float, b: float) -> float:
    """Mean negative log-likelihood of the labels."""
    t = np.clip(a + b * x, -30, 30)
    return float(np.mean(np.log1p(np.exp(t)) - y * t))


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Word scores from all labelled documents whose remainder is not 2. The law, the probability
    and the least likelihood ratio of a feature come from the same documents by cross-fitting:
    those of each remainder are judged by scores learned from the other two.

    A feature's weight is the log-odds that a toxic rather than a clean document holds it.
    At most how.documents labelled rows (smallest hash of the id) are used: they are broadcast,
    so only documents that they name are read. Rows with a null id or label count for nothing;
    a document labelled more than once counts once, as toxic if any label says so. Without
    labelled documents of both kinds, every text gets the same small score.
    """
    fold = remainder().alias("fold")
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"), fold)
        .where("fold <> 2 and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.first("fold").alias("fold"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(how.documents)
    )
    used = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # Copies and near copies of one text would make all its words look telling: one of them stays.
    # Those that share their smallest word triple under either of two hashes are compared.
    used = used.select("*", _marks(F.col("text")).alias("mark")).select("doc_id", "text", "toxic", "fold", "mark.*")
    used = _without_copies(_without_copies(used, "a", how.percent), "b", how.percent)
    used = saved(used.select("text", "toxic", "fold"), "labelled")

    lengths, folds = how.prefixes, (0, 1, 3)
    counted = used.select("text", "toxic", "fold").mapInPandas(
        lambda batches: _count(batches, lengths), "fold int, feature string, docs0 long, docs1 long, uses0 long"
    )
    names = ("docs0", "docs1", "uses0")
    per_fold = [
        F.sum(F.when(F.col("fold") == k, F.col(n)).otherwise(0)).alias(f"{n}_{k}") for k in folds for n in names
    ]
    counted = saved(counted.groupBy("feature").agg(*per_fold), "features")

    def over(some) -> DataFrame:
        return counted.select("feature", *(sum(F.col(f"{n}_{k}") for k in some).alias(n) for n in names))

    finals = _fits(over(folds), how)
    if finals is None:
        return EMPTY
    parts = []
    for k in folds:
        models = _fits(over([j for j in folds if j != k]), how)
        if models is not None:
            parts.append((used.where(F.col("fold") == k), models))

    # One clean document in twenty has a best segment beyond the level at which K n exp(-lambda s)
    # is -log(0.95): that fixes K.
    tails: list[list[float]] = [[] for _ in how.clear]
    for rows, models in parts:
        for r in _judged(rows, models, lambda n, found, _: max((s for s, _, _ in found), default=0.0)):
            if not r["toxic"] and r["n"]:
                for tail, model, best in zip(tails, models, r["value"], strict=True):
                    tail.append(model.steepness * best - math.log(r["n"]))
    spreads = [float(np.quantile(t, 0.95)) + math.log(-math.log(0.95)) if t else 0.0 for t in tails]
    seen = []
    for rows, models in parts:
        lawful = [replace(m, spread=s) for m, s in zip(models, spreads, strict=True)]
        seen += _judged(rows, lawful, significance)
    x = np.minimum(np.array([r["value"] for r in seen]), 50.0)
    y = np.array([float(r["toxic"]) for r in seen])
    if not len(y) or y.min() == y.max():
        return replace(finals[-1], spread=spreads[-1], a=-4.0, b=0.5)
    # Rows come in no fixed order and sums of floats depend on it.
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    curves = [_logistic(x[:, i], y) for i in range(len(how.clear))]
    losses = [_loss(x[:, i], y, *curve) for i, curve in enumerate(curves)]
    i = int(np.argmin(losses))
    return replace(finals[i], spread=spreads[i], a=curves[i][0], b=curves[i][1])


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with one more column, by name: score (0 to 1), n_segments that are significant and
    the word positions (first, last) of the strongest of them.

    Every text is read whole, one row at a time, without a shuffle. Null and empty texts have
    no segment and the lowest score; a column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # words of the fit's documents

    @F.pandas_udf("score double, n_segments long, passages array<array<long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        model, memo = sent.value, {}
        for texts in releasing(batches):
            rows = []
            for text in texts:
                n, found = passages(text, model, memo)
                level = (model.spread + math.log(max(n, 1))) / model.steepness
                strong = sorted((s for s in found if s[0] > level), reverse=True)
                x = min(significance(n, strong, model), 50.0)
                rows.append((probability(x, model), len(strong), sorted([int(f), int(t)] for _, f, t in strong)))
            yield pd.DataFrame(rows, columns=["score", "n_segments", "passages"])

    return docs.withColumn(name, run("text"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    rate = F.col("toxicity")["score"]
    return scored.select(
        "doc_id",
        (remainder() == 2).alias("held_out"),
        rate.alias("score"),
        F.when(rate >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
