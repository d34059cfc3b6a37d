"""URL filters: listed rules first, then a classifier over segmented names.

Host names run words together. A unigram model over the words of all pages splits them by
Viterbi; multinomial naive Bayes over the words of host and path, hashed to a fixed number of
buckets, judges what no rule decides. It learns from the urls that rules decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm.common import FOLD, LOWER, UPPER, saved, table

BUCKETS = 1 << 16
LONGEST = 63  # letters of a host's name, by the rules of host names
SMOOTH = 0.1
SALTS = 16


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# fixed values: verdict, host, path
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased. Path: on from there up to ?
    or #. Both are empty for null and for urls without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def decided(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits: its host or a subdomain, and a path that
    starts with its path; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a-z in page texts, counted within the task before they are shuffled."""
    held: Counter = Counter()
    frame = lambda c: pd.DataFrame({"word": list(c.keys()), "n": list(c.values())})
    for batch in batches:
        for html in batch["html"]:
            text = MARKUP.sub(" ", html or "").translate(FOLD)
            held.update(w for w in re.findall("[a-z]+", text) if len(w) <= LONGEST)
            if len(held) > 200_000:
                yield frame(held)
                held.clear()
    if held:
        yield frame(held)


def lexicon(pages: DataFrame) -> DataFrame:
    """word, n: how often each word of a-z, of LONGEST letters at most, is in the pages' texts."""
    counted = pages.select("html").mapInPandas(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, counts: dict[str, int], total: float) -> list[str]:
    """The likeliest split of a name into words; an unknown piece costs more the longer it is."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    unit = math.log(max(total, 1.0))
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end], 0)
            cost = unit - math.log(n) if n else unit + (end - start) * math.log(10.0)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host -> host, tokens: the words of its names and its numbers.

    A name's pieces are joined with the lexicon, so nothing of the lexicon is broadcast; the
    pieces of one name, at most LONGEST per letter, meet in one row.
    """
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    parts = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit("[a-z]+|[^a-z.-]+"), F.lit(0))).alias("name"))
    parts = saved(parts, "names")
    names = parts.select("name").distinct().where(F.col("name").rlike(r"\A[a-z]{2,}\z"))
    pieces = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i")).select(
        "name",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("i") + 1)),
                lambda n: F.substring(F.col("name"), F.col("i"), n),
            )
        ).alias("word"),
    )
    known = pieces.distinct().join(words, "word").groupBy("name").agg(
        F.collect_list(F.struct("word", "n")).alias("known")
    )

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        made = (
            viterbi(a, {r["word"]: r["n"] for r in (() if b is None else b)}, total)
            for a, b in zip(name, known, strict=True)
        )
        return pd.Series(list(made), dtype=object)

    cut = names.join(known, "name", "left").select("name", split("name", "known").alias("tokens"))
    cut = saved(cut, "segments")
    whole = F.coalesce("tokens", F.array("name"))
    return (
        parts.join(cut, "name", "left")
        .select("host", whole.alias("tokens"))
        .groupBy("host")
        .agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    )


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Bayes:
    """Log-odds of block against allow: of a token, by bucket, and before any token."""

    weights: np.ndarray
    prior: float


def learn(tokens: DataFrame, urls: dict[str, int]) -> Bayes:
    """From (token, verdict, n) counts; urls: how many have each verdict. SMOOTH is added to each
    bucket that has a token, of either verdict; buckets without any say nothing. At most two
    rows per bucket reach the driver."""
    rows = tokens.groupBy(_bucket(F.col("token")).alias("bucket"), "verdict").agg(F.sum("n").alias("n")).collect()
    counts = {v: np.zeros(BUCKETS) for v in ("allow", "block")}
    for r in rows:
        counts[r["verdict"]][r["bucket"]] += r["n"]
    seen = counts["allow"] + counts["block"] > 0
    odds = {v: np.zeros(BUCKETS) for v in counts}
    for v, c in counts.items():
        odds[v][seen] = np.log((c[seen] + SMOOTH) / (c.sum() + SMOOTH * seen.sum()))
    prior = math.log((urls.get("block", 0) + 1) / (urls.get("allow", 0) + 1))
    return Bayes(odds["block"] - odds["allow"], prior)


def _score(tokens: Column, bayes: Bayes) -> Column:
    weights = bayes.weights

    @F.pandas_udf("double")
    def add(buckets: pd.Series) -> pd.Series:
        return pd.Series([float(weights[np.asarray(b, dtype=int)].sum()) for b in buckets], dtype=float)

    return add(F.transform(tokens, _bucket))


def judge(pages: DataFrame, rules=RULES, teach: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds: one row per row of pages.

    Rules decide where one fits; elsewhere a url is blocked if the odds of naive Bayes are
    above even. Null urls, and those without ://, have empty host and path and get the prior's
    verdict; null html has no words; repeated rows are judged each; an empty table gives no
    rows; other columns are left out; very long hosts are split into names of LONGEST letters at
    most, and words of pages beyond that cannot be part of a name. All pages feed the lexicon and
    all urls that rules decide feed the classifier, counted before they are shuffled; with
    `teach`, a condition on pages, only those that it holds for do, so that the others can test
    it. Scores of hosts are joined back on (host, salt), so a host that holds much of the table
    is spread over SALTS keys.
    """
    host, path = host_and_path(F.col("url"))
    teach = F.lit(True) if teach is None else teach
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), teach.alias("teach"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    words = F.regexp_extract_all(F.translate("path", UPPER, LOWER), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    urls = urls.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("listed"),
        F.when(F.col("teach"), verdict).alias("lesson"),
        words.alias("tokens"),
    )
    by_host = saved(urls.groupBy("host", "lesson").agg(F.count(F.lit(1)).alias("n")), "hosts")
    cut = saved(segmented(by_host.select("host").distinct(), saved(lexicon(pages), "lexicon")), "split_hosts")

    taught = by_host.where("lesson is not null")
    seen = {r["lesson"]: r["n"] for r in taught.groupBy("lesson").agg(F.sum("n").alias("n")).collect()}
    in_hosts = taught.join(cut, "host").select(
        F.explode("tokens").alias("token"), F.col("lesson").alias("verdict"), "n"
    )
    in_paths = urls.where("lesson is not null").select(
        F.explode("tokens").alias("token"), F.col("lesson").alias("verdict"), F.lit(1).cast("bigint").alias("n")
    )
    bayes = learn(in_hosts.unionByName(in_paths), seen)

    scored = cut.select("host", _score(F.col("tokens"), bayes).alias("host_odds"))
    scored = scored.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    scored = saved(scored, "scored_hosts")
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    odds = F.lit(bayes.prior) + F.coalesce("host_odds", F.lit(0.0)) + F.col("path_odds")
    return (
        urls.select("*", salt.alias("salt"), _score(F.col("tokens"), bayes).alias("path_odds"))
        .join(scored, ["host", "salt"], "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("listed", F.when(odds > 0, "block").otherwise("allow")).alias("verdict"),
            odds.alias("log_odds"),
        )
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
