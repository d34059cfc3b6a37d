"""Secret scans: patterns for named secrets, and a token-efficiency test for unnamed ones.

Random strings cost many tokens: a vocabulary trained on prose has few long pieces for them.
A run of key-like characters that gets less than `max_ratio` characters out of each token is
reported, unless it is a known digest or identifier. Of a readable run, the parts between
separators and the stretches of short tokens are tested alone, so words next to a key do not hide it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm.common import held, release, table
from weekgrain.llm.toxicity import segments

# fixed values: the base patterns, by kind, in the order of the kinds
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# fixed values: lengths in hex digits of md5, sha1, sha224, sha256, sha384, sha512
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
NUMBER = re.compile(r"[0-9_=+/-]+\Z")
LEAST = 20  # characters of a candidate
PART = re.compile(r"[A-Za-z0-9]+")
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern[:-2]}|{DIGEST.pattern[:-2]})(?![A-Za-z0-9])", re.I)


@dataclass(frozen=True)
class Scan:
    """vocabulary: a tiktoken rank file, the installed one if none is named. excess: tokens that a
    stretch inside a readable run must have beyond its characters over max_ratio."""

    vocabulary: str | None = None
    max_ratio: float = 2.0
    excess: float = 2.5


def encoding(path: str | None):
    """One per Python worker, until the worker holds something else."""

    def make():
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(("encoding", path), make)


def _key_like(run: str) -> bool:
    """Long enough, and of letters that no drawing, number or sequence of bases is made of."""
    return len(run) >= LEAST and len(set(run)) > 4 and 4 * sum(c.isalpha() for c in run) >= len(run)


def _name(run: str) -> bool:
    """Words of one kind of letter, joined by separators, as in names of constants and paths. Many
    of them are near two characters a token, so they need more evidence than a ratio."""
    kinds = (any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run[1:]))
    return sum(kinds) < 2 and PART.fullmatch(run) is None


def _short(run: str, scan: Scan) -> bool:
    return len(run) < scan.max_ratio * len(encoding(scan.vocabulary).encode_ordinary(run))


def _stretches(run: str, scan: Scan) -> list[tuple[int, int]]:
    """Parts of a readable run that the vocabulary compresses badly: those between separators,
    and the maximal segments of short tokens, widened to whole parts."""
    parts = [m.span() for m in PART.finditer(run)]
    found = [(a, b) for a, b in parts if _key_like(run[a:b]) and _short(run[a:b], scan)]
    enc = encoding(scan.vocabulary)
    ends = [0]
    for token in enc.encode_ordinary(run):
        ends.append(ends[-1] + len(enc.decode_single_token_bytes(token)))
    scores = [1 - (b - a) / scan.max_ratio for a, b in zip(ends, ends[1:])]
    for score, first, last in segments(scores, list(range(len(scores))), -1.0):
        if score >= scan.excess:
            start, end = ends[first], ends[last + 1]
            start = min([start, *(a for a, b in parts if a <= start < b)])
            end = max([end, *(b for a, b in parts if a < end <= b)])
            if _key_like(run[start:end]):
                found.append((start, end))
    return merged(found)


def random_runs(text: str, scan: Scan, taken: list[tuple[int, int]] = []) -> list[tuple[int, int]]:  # noqa: B006
    """Spans of key-like runs that the vocabulary compresses badly, without what is taken (spans in
    order) and without known digests and identifiers."""
    found = []
    starts = [a for a, _ in taken]
    for m in CANDIDATE.finditer(text):
        holes = taken[max(bisect_left(starts, m.start()) - 1, 0) : bisect_left(starts, m.end())]
        holes = merged([*holes, *(k.span() for k in KNOWN.finditer(text, *m.span()))])
        at = m.start()
        for start, end in [*holes, (m.end(), m.end())]:
            run = text[at:start]
            if len(run) >= LEAST and not NUMBER.match(run) and len(set(run)) > 4:
                if not _name(run) and _short(run, scan):
                    found.append((at, start))
                else:
                    found += [(at + a, at + b) for a, b in _stretches(run, scan)]
            at = max(at, end)
    return found


def find(text: str, scan: Scan = Scan()) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind as listed in KINDS.

    The three base kinds are leftmost, longest runs. Random runs are looked for in what base spans
    leave.
    """
    spans = [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    spans += [(*m.span(), 2) for m in HEX.finditer(text)]
    taken = merged(spans)
    spans += [(start, end, 3) for start, end in random_runs(text, scan, taken)]
    return [(s, KINDS[k], e) for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1]))]


def merged(spans) -> list[tuple[int, int]]:
    """The stretches that spans of the form (start, end, ...) cover, by start."""
    out: list[tuple[int, int]] = []
    for start, end, *_ in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[secret]") -> str:
    """Spans, joined where they overlap, replaced by the mark."""
    out, at = [], 0
    for start, end in merged((s, e) for s, _, e in spans):
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def _spell(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _row(text: str | None, scan: Scan) -> tuple:
    text = text or ""
    spans = find(text, scan)
    base = _spell(x for x in spans if x[1] != "random")
    n = [sum(x[1] == k for x in spans) for k in KINDS]
    return *n, hashlib.sha256(base.encode()).hexdigest(), _spell(spans), redact(text, spans)


FOUND = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string", "redacted": "string"}


def scan_texts(docs: DataFrame, scan: Scan = Scan(), name: str = "found") -> DataFrame:
    """docs with one more column, by name: the counts and spans by kind and the redacted text.

    A null text is empty and has no spans; repeated rows give repeated results; an empty table
    gives none; a column of that name is replaced. Every text is scanned whole, row by row, so
    there is no shuffle.
    """

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in FOUND.items()))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(t, scan) for t in texts], columns=list(FOUND))

    return docs.withColumn(name, run("text"))


def clean(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """docs with every secret in text replaced by a mark and n_chars, where there is one,
    following. All rows stay, a null text stays null."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = [None if t is None else redact(t, find(t, scan)) for t in texts]
        release()
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", cleaned("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        out = out.withColumn("n_chars", chars)
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
    return found.select("doc_id", *(F.col("found")[n].alias(n) for n in names))
