"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one valid last token: the one that BPE gives the prefix.
A token may stand last if the prefix before it ends in a token with which it is a valid pair (BPE
leaves the two as they are). The table of last tokens is filled from left to right, in time linear
in the text, and read from the end. Appending goes on where the table ends; after an edit the table
is refilled from the edit until it agrees with the old one over a token's greatest length.

Nulls and odd rows: a null or empty text has no tokens and decodes to no bytes; repeated rows are
encoded alike; other columns pass through, those named like a result are replaced. Decoding null
gives no bytes; ids that the vocabulary lacks are an error.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 256
KEPT = 1 << 20
KEPT_HEADS = 1 << 17
HEADS = (9, 7, 5)


class Vocabulary:
    """Byte strings with ranks; ids are the ranks."""

    def __init__(self, file: bytes):
        pairs = (line.split() for line in file.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.sizes = {i: len(token) for i, token in self.tokens.items()}
        self.longest = max(map(len, self.ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.heads: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """BPE as defined: merge the neighbours of lowest rank, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 62:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def whole(self, token: int) -> bool:
        """Whether BPE makes this token of its own bytes."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merge(self.tokens[token]) == [token]
        return found

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Add the last tokens of the next prefixes of ``data``, up to ``stop`` bytes."""
        rank, pair, alone = self.ranks.get, self.pairs.get, self.alone.get
        for end in range(len(last), stop + 1):
            for start in range(max(0, end - self.longest), end):
                token = rank(data[start:end])
                if token is None:
                    continue
                if start:
                    ok = pair((last[start], token))
                    if ok is None:
                        ok = self.valid(last[start], token)
                else:
                    ok = True
                if ok and (alone(token) or self.whole(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")


class Prefixes:
    """The last token of every prefix of a byte string, which can grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:stop]; returns how many prefixes were redone."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend(self.data, self.last, end)
            before = end - shift
            same = same + 1 if before > stop and old[before] == self.last[end] else 0
            if same >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return _read(self.vocabulary, self.last)


def _read(vocabulary: Vocabulary, last: list[int]) -> list[int]:
    """The ids from a table of last tokens, read from its end."""
    out, end = [], len(last) - 1
    while end:
        token = last[end]
        out.append(token)
        end -= vocabulary.sizes[token]
    return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one match of the pattern; a match that is itself a token is that token.

    Matches that begin alike share the beginning of their tables, which is appended to.
    """
    token = vocabulary.ranks.get(piece)
    if token is not None:
        return [token]
    heads = vocabulary.heads
    for size in HEADS:
        last = heads.get(piece[:size])
        if last is not None:
            last = last.copy()
            break
    else:
        last = [-1]
    begun = len(last) - 1
    vocabulary.extend(piece, last, len(piece))
    for size in HEADS:
        if begun < size < len(piece):
            if len(heads) > KEPT_HEADS:
                heads.clear()
            heads[piece[:size]] = last[: size + 1]
    return _read(vocabulary, last)


class Known(dict):
    """Matches met with their ids as bytes, started anew when full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> bytes:
        ids = array("I", encode_piece(self.vocabulary, match.encode("utf-8"))).tobytes()
        if len(match) <= 64:  # longer ones hardly come back
            if len(self) >= KEPT:
                self.clear()
            self[match] = ids
        return ids


@lru_cache(maxsize=1)
def _known(file: bytes) -> Known:
    """The vocabulary and what was met of it; a Python worker that is used again goes on with it."""
    return Known(Vocabulary(file))


def _added(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    plain = docs.drop(*columns)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
    return plain, ", ".join(fields + [f"{c} binary" for c in columns])


def _decoded(vocabulary: Vocabulary, ids: bytes | None) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, array("I", ids or b"")))


def _encode(docs: DataFrame, path: str, pattern: str, text: str, columns: list[str], keep_text: bool = True) -> DataFrame:
    """``docs`` with ``columns``: ``ids`` and, if named, ``decoded`` from those ids.

    The vocabulary file is read on the driver and sent to the tasks: its size is that of a
    vocabulary, whatever the corpus.
    """
    with open(path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    plain = docs.drop(*columns)
    kept = [i for i, c in enumerate(plain.columns) if keep_text or c != text]
    _, schema = _added(plain.select([f"`{plain.columns[i]}`" for i in kept]), *columns)
    names, at = [*[plain.columns[i] for i in kept], *columns], plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches, known = regex.compile(pattern), _known(sent.value)
        vocabulary = known.vocabulary
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                ids = [b"".join(map(known.__getitem__, matches.findall(x.as_py() or ""))) for x in part.column(at)]
                more = [pa.array(ids, pa.binary())]
                if len(columns) > 1:
                    more.append(pa.array([_decoded(vocabulary, x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *more], names)

    return plain.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the token ids of the whole text as little-endian 32-bit numbers."""
    return _encode(docs, path, pattern, text, ["ids"])


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` and with ``decoded``, the bytes that those ids stand
    for, in one pass: one Python worker a task, with one vocabulary."""
    return _encode(docs, path, pattern, text, ["ids", "decoded"], keep_text=False)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded``: the bytes that ``ids`` stand for."""
    with open(path, "rb") as file:
        sent = tokens.sparkSession.sparkContext.broadcast(file.read())
    plain, schema = _added(tokens, "decoded")
    names, at = [*plain.columns, "decoded"], plain.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _known(sent.value).vocabulary
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                out = [_decoded(vocabulary, x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names)

    return plain.mapInArrow(run, schema)


def digests(tokens: DataFrame) -> list:
    return [
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
