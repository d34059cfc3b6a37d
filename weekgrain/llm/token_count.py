"""Token counts by finite-state transducers.

Two transducers, run one in the other. The outer one cuts text into pretokens. The inner one
reads a pretoken byte by byte and knows, at every place, the last token of the encoding of what
it has read; its transitions carry the number of tokens that this adds or takes back, so their
sum is the pretoken's count. Its states are compiled when they are first met.

Long texts are cut into chunks. A chunk's map from entry states to exit states and counts is
constant once it has read a synchronising place (white space after something else), so it is kept
as the text before the first such place, the count between, and the text after the last. Such
maps compose associatively; a prefix scan over a text's chunks gives its count.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm.common import table

CHUNK = 1 << 16
LIMIT = 1024
MEMO, STATES = 400_000, 200_000

# fixed values: white space, and the pretoken pattern of the byte-level vocabulary
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{space}{other}]+|[{space}]+(?![^{space}])|[{space}]+"
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
# Within these letters, two fast classes say the same as the Unicode properties.
PLAIN = re.compile(f"[\x00-\x7f{LATIN}]*\\Z")
FAST = re.compile(
    PATTERN.format(letter=f"[A-Za-z{LATIN}]", number="[0-9]", space=SPACE, other=f"A-Za-z0-9{LATIN}")
)
IS_SPACE = re.compile(f"[{SPACE}]")
SYNC = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the rest in order
    from the first code point beyond a byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The inner transducer of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_letters()
        raw = lambda token: bytes(byte[c] for c in token)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.starts = {t[:n] for t in self.tokens for n in range(1, len(t) + 1)}
        self.slow = regex.compile(
            PATTERN.format(letter=r"\p{L}", number=r"\p{N}", space=SPACE, other=r"\p{L}\p{N}")
        )
        self.follows: dict[tuple[bytes | None, bytes], bool] = {}
        self.memo: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        # A state: the longest read suffix that begins some token, and its places that matter:
        # those from which the rest begins a token, and the end. Each has the last token of the
        # encoding up to there, and how many tokens fewer that encoding has.
        self.states = [(b"", ((0, None, 0),))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, text: bytes) -> list[bytes]:
        """Plain byte-pair merging, lowest rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: bytes | None, token: bytes) -> bool:
        """Whether the encoding of both texts together is just these two tokens."""
        got = self.follows.get((left, token))
        if got is None:
            want = [token] if left is None else [left, token]
            got = self.follows[left, token] = self.merge(b"".join(want)) == want
        return got

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The move from a state on a byte: next state, tokens added."""
        suffix, places = self.states[state]
        text = suffix + bytes([byte])
        for i, left, behind in places:
            token = text[i:]
            if token in self.tokens and self.may_follow(left, token):
                added = 1 - behind
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        kept = [(i, t, n + added) for i, t, n in places if text[i:] in self.starts]
        first = kept[0][0] if kept else len(text)
        kept.append((len(text), token, 0))
        key = (text[first:], tuple((i - first, t, n) for i, t, n in kept))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (to, added)
        return move

    def pretoken(self, word: str) -> int:
        state = count = 0
        if len(self.states) > STATES:
            self.reset()
        for byte in word.encode():
            move = self.moves[state].get(byte) or self.compile(state, byte)
            state = move[0]
            count += move[1]
        return count

    def _ordinary(self, text: str) -> int:
        memo = self.memo
        count = 0
        for word in (FAST if PLAIN.match(text) else self.slow).findall(text):
            n = memo.get(word)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = memo[word] = self.pretoken(word)
            count += n
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it are one token each."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        return len(parts) - 1 + sum(map(self._ordinary, parts))


@lru_cache(maxsize=2)
def transducer(path: str | None) -> Transducer:
    import public_tokenizers

    return Transducer(path or public_tokenizers.path("byte_bpe_50k.json"))


# A chunk's map: text before the first synchronising place, tokens up to the last one, text
# after it; without such a place all text is in the first, and the last is None.
ChunkMap = tuple[str, int, str | None]


def chunk_map(text: str, machine: Transducer) -> ChunkMap:
    first = SYNC.search(text)
    if not first:
        return text, 0, None
    start, last = first.end(), len(text) - 1
    while not (IS_SPACE.match(text, last) and not IS_SPACE.match(text, last - 1)):
        last -= 1
    return text[:start], machine.count(text[start:last]), text[last:]


def compose(a: ChunkMap, b: ChunkMap, machine: Transducer) -> ChunkMap:
    """The map of a, then b."""
    if a[2] is None:
        return a[0] + b[0], b[1], b[2]
    if b[2] is None:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + machine.count(a[2] + b[0]) + b[1], b[2]


def apply(m: ChunkMap, machine: Transducer) -> int:
    """Tokens of the whole text that a map stands for, from the start state."""
    return machine.count(m[0]) + m[1] + machine.count(m[2] or "")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs.

    path: a byte-level vocabulary file, the installed one if none is named. A null or empty text
    has no bytes and no tokens; repeated rows are counted each; an empty table gives no rows;
    other columns are left out. What is shuffled per chunk is two text ends of a word or so;
    only text without any white space travels whole.
    """

    @F.pandas_udf("head string, n long, tail string")
    def maps(texts: pd.Series) -> pd.DataFrame:
        machine = transducer(path)
        return pd.DataFrame([chunk_map(t or "", machine) for t in texts], columns=["head", "n", "tail"])

    @F.pandas_udf("long")
    def total(chunks: pd.Series) -> pd.Series:
        machine = transducer(path)
        whole = lambda parts: reduce(
            lambda a, b: compose(a, b, machine), ((p["head"], p["n"], p["tail"]) for p in parts)
        )
        return pd.Series([apply(whole(parts), machine) for parts in chunks], dtype="int64")

    text = F.coalesce("text", F.lit(""))
    # Rows are numbered before they are unfolded, so that a text's chunks share a number.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    rows = rows.select(
        "row",
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.posexplode_outer(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % chunk), F.lit(0))).alias("place", "part"),
    )
    seen = rows.select("row", "doc_id", "n_bytes", "place", maps("part").alias("m"))
    whole = seen.groupBy("row", "doc_id", "n_bytes").agg(
        F.array_sort(F.collect_list(F.struct("place", "m.head", "m.n", "m.tail"))).alias("chunks")
    )
    return whole.select("doc_id", "n_bytes", total("chunks").alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
