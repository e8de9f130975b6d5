"""Encoding whole texts with a public byte-level BPE vocabulary.

The encoder backtracks over longest matches instead of replaying merges.  An
Aho-Corasick automaton finds every vocabulary token in a piece; from the left,
the longest token is taken whose pair with the one before it is compatible,
that is, whose joint encoding is that very pair.  Where none is, the position
is marked dead and the token before is shortened.  Each position is visited
once per candidate prefix, so the work is linear in the text, and the result is
exactly the one of the merges.

Decoding concatenates slices of one byte string through an offset table.

Edge cases: null and empty texts give an empty list; special token strings in a
text are ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; they are read on the driver only and broadcast (under 2 MB).
VOCABULARIES = os.environ.get("FOLIOFLOW_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.tiktoken"
#: Fixed: the public pattern that splits a text before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept by a worker; a memo only, it never changes a result.
MEMO = 1 << 17


@dataclass
class Vocabulary:
    """Token bytes by id, and the two parts of each token's last merge (itself twice for a byte)."""

    blob: bytes
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def token(self, i: int) -> bytes:
        return self.blob[self.offsets[i] : self.offsets[i + 1]]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file with one base64 token and its rank on each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    left = np.arange(len(tokens), dtype=np.int32)
    right = left.copy()
    for i, token in enumerate(tokens):
        if len(token) > 1:
            left[i], right[i] = _last_merge(token, ranks)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    return Vocabulary(b"".join(tokens), np.concatenate([[0], np.cumsum(sizes)]), left, right)


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Encoder(dict):
    """Piece -> ids, a memo that fills itself; ``encode`` splits a text and joins the pieces' ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        import ahocorasick
        import regex

        self.split = regex.compile(PIECES).findall
        # bytes stand as the first 256 characters, so that the automaton can hold them
        names = [vocabulary.token(i).decode("latin-1") for i in range(len(vocabulary.left))]
        self.whole = {name: i for i, name in enumerate(names)}
        self.length = [len(name) for name in names]
        self.left, self.right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self.joined = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if self.length[i] > 1}
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.names = names

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self._search(piece.encode("utf-8").decode("latin-1")))
        if len(self) >= MEMO:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            out += self[piece]
        return out

    def count(self, text: str) -> int:
        return sum(len(self[piece]) for piece in self.split(text))

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 for a single byte."""
        found = self.shorter.get(token)
        if found is None:
            name = self.names[token]
            found = next((self.whole[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.whole), -1)
            self.shorter[token] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a text of tokens ``a`` and ``b`` as exactly these two.

        Undoes merges at the seam, the later one first, and looks for a merge
        across the seam that would have come before the one undone last.
        """
        before = len(self.left)
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < before:
                return False
            for undo_left in (True, False) if a > b else (False, True):
                if undo_left:
                    before, a = a, self.right[a]
                    if a != before:
                        break
                else:
                    before, b = b + 1, self.left[b]
                    if b + 1 != before:
                        break
            else:
                return True

    def _search(self, name: str) -> list[int]:
        token = self.whole.get(name)
        if token is not None and len(name) < 3:
            return [token]
        size = len(name)
        longest = [-1] * size
        for end, token in self.automaton.iter(name):
            start = end + 1 - self.length[token]
            if longest[start] < 0 or self.length[longest[start]] < self.length[token]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0] if size else -1
        while at < size:
            end = at + self.length[token]
            if not dead[end] and (not out or self._compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
                continue
            token = self._prefix(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self._prefix(token)
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, sent) -> Encoder:
    """The worker's encoder of one vocabulary, built once a process."""
    if key not in _encoders:
        _encoders[key] = Encoder(sent.value)
    return _encoders[key]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(name: str = DEFAULT, folder: str | None = None) -> tuple[str, Vocabulary]:
    path = os.path.join(folder or VOCABULARIES, name)
    if path not in _vocabularies:
        _vocabularies[path] = read_vocabulary(path)
    return path, _vocabularies[path]


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (a list of ints) of each row; a narrow stage without any shuffle."""
    return _encoded(df, text, key, name, folder, counts=False)


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` (bigint) of each row; 0 for empty and null texts."""
    return _encoded(df, text, key, name, folder, counts=True)


def _encoded(df: DataFrame, text: str, key: str, name: str, folder: str | None, counts: bool) -> DataFrame:
    path, read = vocabulary(name, folder)
    sent = df.sparkSession.sparkContext.broadcast(read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, sent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if counts:
                values = pa.array([encoder.count(t) if t else 0 for t in texts], pa.int64())
            else:
                lists = [encoder.encode(t) if t else [] for t in texts]
                sizes = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
                flat = np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(sizes.sum()))
                values = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), values], [key, "n_tokens" if counts else "ids"])

    kept = df.select(F.col(key), F.col(text).alias("text"))
    kind = dict(kept.dtypes)[key]
    return kept.mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if counts else "ids array<int>"))


def decode(ids: list[int], read: Vocabulary) -> str:
    """The text of ids, by slices of the offset table."""
    return b"".join(read.blob[read.offsets[i] : read.offsets[i + 1]] for i in ids).decode("utf-8")
