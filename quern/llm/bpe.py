"""Encoding of a corpus with a public byte-pair vocabulary.

The merges are read as a transducer over bytes. Its state after a byte is the last token of the
encoding of the bytes so far; that state exists and is unique, because the encoding of a prefix
extended by a token is the encoding of the longer text exactly if the two tokens at the seam are
what the merges would leave there. States are therefore never built from the merge list: a
transition is searched for at every byte and not kept, so no automaton is determinised; seam tests are
kept by token pair, and whole words by their text. A token is emitted as soon as every state that
can still be extended agrees on it, which is at most the longest token's length behind.

Defined results: null and '' have no ids; what looks like a special token is ordinary text; every
other text decodes to itself.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files are, unless a query is given another folder.
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker; beyond that the kept ones are forgotten.
KEEP_WORDS = 400_000
#: Bytes of a word after which tokens are emitted while the word goes on.
EMIT_EVERY = 4096


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or TOKENIZERS, name)


class Transducer:
    """The lazily built transducer of one vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._seams: dict[tuple[int, int], bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte."""
        if token not in self._parts:
            text = self.tokens[token]
            if len(text) == 1:
                self._parts[token] = None
            else:
                seq = [text[i : i + 1] for i in range(len(text))]
                while len(seq) > 2:
                    at = min(range(len(seq) - 1), key=lambda i: self.ids.get(seq[i] + seq[i + 1], 1 << 60))
                    seq[at : at + 2] = [seq[at] + seq[at + 1]]
                self._parts[token] = (self.ids[seq[0]], self.ids[seq[1]])
        return self._parts[token]

    def holds(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side.

        The merges that made the two are undone, latest first. If the two tokens that then touch
        at the seam form a token that would have been made before the one just undone, the merges
        would have joined them across the seam.
        """
        key = (left, right)
        known = self._seams.get(key)
        if known is None:
            if len(self._seams) > 4_000_000:
                self._seams.clear()
            known = self._seams[key] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        before = 1 << 60
        a, b = self.tokens[left], self.tokens[right]
        while True:
            joined = self.ids.get(a + b)
            if joined is not None and joined < before:
                return False
            # of two equal ids at the seam the left one was made first, so the right one is undone first
            rank_a = left if self.parts(left) else -1
            rank_b = right if self.parts(right) else -1
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                before, left = left, self.parts(left)[1]
                a = self.tokens[left]
            else:
                before, right = right + 1, self.parts(right)[0]
                b = self.tokens[right]

    def stream(self, word: bytes) -> Iterator[int]:
        """The ids of one word, emitted in order while it is read."""
        start, states = 0, []  # states[i]: last token of the encoding of word[start : start + i + 1]
        n = len(word)
        for end in range(1, n + 1):
            at = end - start
            for size in range(min(self.longest, at), 0, -1):
                token = self.ids.get(word[end - size : end])
                if token is not None and (size == at or self.holds(states[at - size - 1], token)):
                    states.append(token)
                    break
            if len(states) >= EMIT_EVERY + self.longest and end < n:
                settled = self._settled(states)
                if settled:
                    # the last settled token stays in front, so that seams can still be tested
                    used = sum(len(self.tokens[t]) for t in settled[:-1])
                    yield from settled[:-1]
                    start, states = start + used, states[used:]
        yield from self._back(states, len(states))

    def _back(self, states: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(states[end - 1])
            end -= len(self.tokens[states[end - 1]])
        out.reverse()
        return out

    def _settled(self, states: list[int]) -> list[int]:
        """The tokens that all states within reach of a further token have in common."""
        n, common = len(states), None
        for end in range(n - self.longest + 1, n + 1):
            path = self._back(states, end)
            if common is None:
                common = path
            else:
                k = 0
                while k < min(len(common), len(path)) and common[k] == path[k]:
                    k += 1
                common = common[:k]
        return common or []


class Encoder:
    """Text to ids, with the words of a worker kept."""

    def __init__(self, path: str) -> None:
        self.machine = Transducer(path)
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        whole = self.machine.ids.get(data)
        ids = (whole,) if whole is not None else tuple(self.machine.stream(data))
        if len(word) <= 64:
            if len(self.kept) >= KEEP_WORDS:
                self.kept.clear()
            self.kept[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get = self.kept.get
        for m in self.words.findall(text):
            ids = get(m)
            out += self._word(m) if ids is None else ids
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get, n = self.kept.get, 0
        for m in self.words.findall(text):
            ids = get(m)
            n += len(self._word(m) if ids is None else ids)
        return n


class Decoder:
    """Ids to text piece by piece; bytes of an unfinished character wait for the next call."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.tokens = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self._utf8.decode(b"".join(self.tokens[i] for i in ids), final)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Rows after which a worker hands its results back, so that long texts do not pile up.
FLUSH_ROWS, FLUSH_IDS = 1000, 1_000_000


def encode_column(df: DataFrame, key: str, text: str = "text", folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row per row of ``df``; only the two named columns are read."""
    path = vocabulary_path(folder, name)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            keys, start, values, offsets = b.column(0), 0, [], [0]
            for i in range(b.num_rows):
                values += enc.encode(b.column(1)[i].as_py())
                offsets.append(len(values))
                if i + 1 - start >= FLUSH_ROWS or len(values) >= FLUSH_IDS or i + 1 == b.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), ids], [key, "ids"])
                    start, values, offsets = i + 1, [], [0]

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str = "text", folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): 0 for null and empty texts."""
    path = vocabulary_path(folder, name)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            counts = pa.array([enc.count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), counts], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
