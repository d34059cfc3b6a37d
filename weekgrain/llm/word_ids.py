"""Ids of the word vocabulary for many texts at once.

White space parts pretokens, so what stands between it always has the same ids. A slice of texts
is split and its different strings numbered by Arrow; these are cut into pretokens, numbered
likewise. Only pretokens not met before are encoded; the ids of all strings, and then those of
all texts, are gathered by number.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weekgrain.llm.common import held

# Pretokens remembered per Python worker, and the longest that is: together some 60 MB.
MEMO = 200_000
LONGEST = 64
# Pretokens given to the library at a time.
TOGETHER = 10_000
# Entries gathered at a time: their places take more memory than what is gathered.
GATHERED = 100_000
# Characters, or bytes, encoded at a time.
SLICE = 1 << 23

# Within these letters the pretoken pattern needs no Unicode properties, lower-casing goes letter
# by letter and nothing composes; other texts, control characters and special strings go to the
# library whole.
LATIN = "À-ÖØ-öø-įı-ſ"
PLAIN = re.compile(f"[\t-\r -~{LATIN}]*\\Z")
# fixed values: of the pretoken pattern of the word vocabulary, for these letters: runs of letters,
# digits alone, runs of all else, and endings after an apostrophe
OTHER, LETTER, DIGIT = 0, 1, 2
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[ord("a") : ord("z") + 1] = LETTER
KINDS[0x80:] = LETTER  # every other letter, in UTF-8
KINDS[ord("0") : ord("9") + 1] = DIGIT
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def texts_of(column: pa.Array, size: int = SLICE) -> Iterator[tuple[slice, list[str]]]:
    """Rows of a column of texts, null as empty, in slices of about `size` bytes: only one slice at
    a time is held as Python strings."""
    for part in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), size):
        yield part, ["" if t is None else t for t in column.slice(part.start, part.stop - part.start).to_pylist()]


def slices(texts: list[str] | list[int], chars: int = SLICE) -> Iterator[slice]:
    """Consecutive slices of about `chars` characters, of texts or of their sizes; a longer text is
    one of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        size = text if isinstance(text, int) else len(text)
        if held and held + size > chars:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries numbered by `at` one after another, and where each ends; entry k is the
    next sizes[k] values of flat."""
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(sizes[at])
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=flat.dtype)
    for first in range(0, len(at), GATHERED):
        some, stops = at[first : first + GATHERED], ends[first : first + GATHERED]
        n = sizes[some]
        begin, end = int(stops[0] - n[0]), int(stops[-1])
        places = np.repeat(starts[some] - (stops - n), n)
        places += np.arange(begin, end)
        out[begin:end] = flat[places]
    return out, ends


def _bounds(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each of some stretches of entries ends, and 0 before, if they begin at entries `at`."""
    return np.concatenate([[0], ends])[at]


def pretokens(strings: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pretokens of lower-cased strings of PLAIN without white space, one after another, and
    how many each string has. All bytes are looked at at once."""
    if not pc.sum(pc.binary_length(strings)).as_py():
        return strings.slice(0, 0), np.zeros(len(strings), dtype=np.int64)
    _, offsets, letters = strings.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(letters, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = KINDS[raw]
    begins = np.ones(len(raw), dtype=bool)
    begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    # An apostrophe within a run of other signs begins nothing.
    at = np.flatnonzero((raw == ord("'")) & begins)
    room = offsets[np.searchsorted(offsets, at, side="right")] - at - 1
    padded = np.concatenate([raw, [0, 0]])
    for ending in ENDINGS:
        n = len(ending)
        fits = room >= n
        for k in range(n):
            fits &= padded[at + 1 + k] == ending[k]
        begins[at[fits] + 1] = False
        after = at[fits] + 1 + n
        begins[after[after < len(raw)]] = True
    places = np.flatnonzero(begins)
    cuts = np.append(places, len(raw))
    found = pa.Array.from_buffers(pa.large_string(), len(places), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
    return found, np.diff(np.searchsorted(places, offsets))


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # The same model for pretokens joined by blanks, which need no normalizer and no pattern.
        self.by_blanks = Tokenizer(self.library.model)
        self.by_blanks.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of pretokens: encoded together, told apart by the tokens that end a word."""
        out = []
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            found = self.by_blanks.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.asarray(found[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the vocabulary does not mark word ends")
            packed, cuts = ids.tobytes(), (4 * stops).tolist()
            out += [packed[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _packed(self, strings: list[str]) -> list[bytes]:
        """Ids of different pretokens. The memory has two halves: when the newer is full it takes
        the place of the older, and what is looked up in the older moves to the newer, so that
        common pretokens stay."""
        if len(self.newer) > MEMO // 2:
            self.older, self.newer = self.newer, {}
        out = [self.newer.get(x) for x in strings]
        missing = [i for i, ids in enumerate(out) if ids is None]
        if self.older:
            for i in missing:
                out[i] = self.older.get(strings[i])
            unknown = [i for i in missing if out[i] is None]
        else:
            unknown = missing
        for i, ids in zip(unknown, self._learn([strings[i] for i in unknown]), strict=True):
            out[i] = ids
        self.newer.update((strings[i], out[i]) for i in missing if len(strings[i]) <= LONGEST)
        return out

    def _of_strings(self, strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for different lower-cased strings of PLAIN without white space."""
        found, counts = pretokens(strings)
        known = found.dictionary_encode()
        packed = self._packed(known.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        flat, ends = gather(np.frombuffer(b"".join(packed), dtype="<u4"), sizes, known.indices.to_numpy())
        return flat, np.diff(_bounds(ends, np.concatenate([[0], np.cumsum(counts)])))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for texts of PLAIN. What one step leaves to none of the next goes before it."""
        lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        del lists
        flat, sizes = self._of_strings(coded.dictionary)
        ids, ends = gather(flat, sizes, coded.indices.to_numpy())
        return ids, np.diff(_bounds(ends, bounds))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has); no special tokens added."""
        plain = [i for i, t in enumerate(texts) if "<|" not in t and PLAIN.match(t)]
        ids, sizes = self._plain([texts[i] for i in plain])
        if len(plain) == len(texts):
            return ids, sizes
        parts = dict(zip(plain, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)) if plain else {}
        every = [parts[i] if i in parts else self._ids(t) for i, t in enumerate(texts)]
        return np.concatenate(every), np.asarray([len(x) for x in every], dtype=np.int64)

    def closed(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with the id `end` after each text."""
        ids, sizes = self.encode(texts)
        out = np.full(len(ids) + len(texts), end, dtype="<u4")
        own = np.ones(len(out), dtype=bool)
        own[np.cumsum(sizes + 1) - 1] = False
        out[own] = ids
        return out, sizes + 1


def word_ids(path: str | None) -> WordIds:
    """One per Python worker, with what it remembers, until the worker holds something else."""

    def make() -> WordIds:
        import public_tokenizers

        return WordIds(path or public_tokenizers.path("word_bpe_49k.json"))

    return held(("word_ids", path), make)
