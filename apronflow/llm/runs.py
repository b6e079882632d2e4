"""Periodic runs of words, found online by dyadic square catching.

``SquareCatcher`` reads a sequence in any portions. Every completed block of 2**j words gets a catcher
that watches the words appended later for a copy of its block at a distance of 2**(j+1) - 1 to
2**(j+2) - 2 words: the first half of any square of such a period holds a whole block. Copies of
neighbouring blocks at one distance merge into one interval; suffix comparisons grow it word by word to its
full extent (in steps of powers of two, over hashes of windows), and an interval as long as its
period is a square. Intervals that reach the end of the sequence grow with the next portion. Hashes only
propose: each reported run is compared word by word.

Nulls and odd rows: a null or empty text has no words, no runs and an empty collapsed text; a null
``doc_id`` and repeated rows are read like any other; other columns are carried whole and may have
any names; an empty table gives an empty result. Memory grows with the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# words read together; a longer text is read alone
PORTION = 1 << 16

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(x: np.ndarray, multiplier: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(multiplier)
    return x ^ (x >> np.uint64(29))


class SquareCatcher:
    """Runs of at least ``exponent`` periods and ``least`` words in an appended sequence of numbers."""

    def __init__(self, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH, seed: int = 0) -> None:
        self.exponent, self.least, self.seed = max(2, exponent), least, seed
        self.words = np.zeros(0, np.int64)
        self.hashes: list[np.ndarray] = []
        # equal stretches [a, b): words a..b equal those p further on
        self.found: dict[tuple[int, int], int] = {}

    def _hash(self, longest: int) -> None:
        """Bring the window hashes of all levels up to the appended words."""
        multiplier = _ODD[self.seed % len(_ODD)] + 2 * (self.seed // len(_ODD))
        n, level = len(self.words), 0
        while 2 ** level <= min(n, longest):
            if level == len(self.hashes):
                self.hashes.append(np.zeros(0, np.uint64))
            known, width = len(self.hashes[level]), n - 2 ** level + 1
            if level == 0:
                fresh = _mixed(self.words[known:].view(np.uint64) + np.uint64(1), multiplier)
            else:
                half, below = 2 ** (level - 1), self.hashes[level - 1]
                fresh = _mixed(below[known:width] * np.uint64(multiplier) + below[known + half : width + half], multiplier)
            self.hashes[level] = np.concatenate([self.hashes[level], fresh]) if known else fresh
            level += 1

    def _grow(self, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extend equal stretches to the left and right as far as they go."""
        a, b, n = a.copy(), b.copy(), len(self.words)
        # growing by the largest window may repeat, the smaller ones fit at most once after it
        for level in range(len(self.hashes) - 1, -1, -1):
            size, hashes, moved = 2 ** level, self.hashes[level], True
            while moved:
                left = np.flatnonzero(a >= size)
                left = left[hashes[a[left] - size] == hashes[a[left] - size + p[left]]]
                right = np.flatnonzero(b + p + size <= n)
                right = right[hashes[b[right]] == hashes[b[right] + p[right]]]
                a[left] -= size
                b[right] += size
                moved = level == len(self.hashes) - 1 and len(left) + len(right) > 0
        return a, b

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Read more words; ``longest`` bounds the length of a run, if one is known."""
        before = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, dtype=np.int64)])
        n = len(self.words)
        self._hash(n if longest is None else longest)
        if self.found and before:
            live = [(a, p) for (a, p), b in self.found.items() if b + p == before]
            if live:
                a, p = (np.array(x, dtype=np.int64) for x in zip(*live))
                _, b = self._grow(a, np.array([self.found[x] for x in live], dtype=np.int64), p)
                self.found.update(zip(live, b.tolist()))
        for level, hashes in enumerate(self.hashes):
            size = 2 ** level
            nearest = 2 * size - 1
            if longest is not None and nearest * self.exponent > longest:
                break
            # blocks whose copies may end in the new words
            first = max(0, -(-(before - 5 * size + 3) // size))
            last = (len(hashes) - 1 - nearest) // size
            if last < first:
                continue
            block = np.arange(first, last + 1) * size
            # a copy beyond the last whole window meets the padding, which no block equals
            span = hashes[first * size :]
            room = (last - first) * size + nearest + 2 * size
            inside = np.zeros(room, bool)
            inside[: len(span)] = True
            if before:
                inside[: max(0, before - size + 1 - first * size)] = False
            padded = np.zeros(room, np.uint64)
            padded[: len(span)] = span[:room]
            view = lambda x: np.lib.stride_tricks.as_strided(x[nearest:], (len(block), 2 * size), (size * x.itemsize, x.itemsize))
            equal = (view(padded) == hashes[block][:, None]) & view(inside)
            # chains of neighbouring blocks with copies at one distance
            column = np.zeros((2 * size, len(block) + 2), np.int8)
            column[:, 1:-1] = equal.T
            edge = np.diff(column, axis=1)
            distance, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            p = distance + nearest
            if not before:
                # a run holds so many whole blocks wherever it starts
                whole = (np.maximum(self.least - p, (self.exponent - 1) * p) - size + 1) // size
                enough = end - begin >= np.maximum(1, whole)
                p, begin, end = p[enough], begin[enough], end[enough]
            if len(p):
                a, b = self._grow(block[begin], block[begin] + (end - begin) * size, p)
                self.found.update(zip(zip(a.tolist(), p.tolist()), b.tolist()))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start, then period."""
        smallest: dict[tuple[int, int], int] = {}
        for (a, p), b in self.found.items():
            length = b - a + p
            if length >= max(self.least, self.exponent * p):
                key = (a, length)
                smallest[key] = min(p, smallest.get(key, p))
        found = sorted((a, length, p) for (a, length), p in smallest.items())
        w, n = self.words, len(self.words)
        for a, length, p in found:
            end = a + length
            whole = np.array_equal(w[a : end - p], w[a + p : end])
            if not whole or (a and w[a - 1] == w[a - 1 + p]) or (end < n and w[end] == w[end - p]):
                # two windows shared a hash: read again with other hashes
                again = SquareCatcher(self.exponent, self.least, self.seed + 1)
                again.append(w)
                return again.runs()
        return sorted(found, key=lambda r: (r[0], r[2]))


def split_words(text: str | None) -> list[bytes]:
    """Maximal stretches without the six ASCII blanks."""
    return text.encode("utf-8").split() if text else []


def _runs_of(texts: list[list[bytes]], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each word list; all are read as one sequence with a separate mark after each."""
    numbers: dict[bytes, int] = {}
    words = [numbers.setdefault(w, len(numbers)) for text in texts for w in text]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    sequence = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    marks = starts + sizes
    sequence[marks] = len(numbers) + np.arange(len(texts))
    plain = np.ones(len(sequence), bool)
    plain[marks] = False
    sequence[plain] = words
    catcher = SquareCatcher(exponent, least)
    catcher.append(sequence, int(sizes.max(initial=0)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catcher.runs():
        owner = int(np.searchsorted(starts, start, side="right")) - 1
        out[owner].append((start - int(starts[owner]), length, period))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by blanks."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words).decode("utf-8")


def _reader(exponent: int, least: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def portion(rows: pa.RecordBatch) -> pa.RecordBatch:
            texts = [split_words(t) for t in rows.column(1).to_pylist()]
            found = _runs_of(texts, exponent, least)
            lists = [[{"start": a, "length": n, "period": p} for a, n, p in f] for f in found]
            arrays = [
                rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(lists, schema),
                pa.array([_collapsed(t, f) for t, f in zip(texts, found)], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "runs", "collapsed"])

        for batch in batches:
            # texts of about PORTION words, judged by their bytes
            sizes = [len(t.as_buffer()) // 6 if t.is_valid else 0 for t in batch.column(1)]
            begin, room = 0, 0
            for i, size in enumerate(sizes):
                if room and room + size > PORTION:
                    yield portion(batch.slice(begin, i - begin))
                    begin, room = i, 0
                room += size + 1
            if begin < len(sizes):
                yield portion(batch.slice(begin))

    return read


def periodic_runs(
    docs: DataFrame, columns: list[str] | None = None, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH
) -> DataFrame:
    """``row`` (the named columns of ``docs``, all by default), n_words, runs (start, length and smallest
    period in words, by start, then period) and the collapsed text, which keeps one period of each run."""
    columns = columns or docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text"))
    kind = StructType([packed.schema["row"]]).simpleString()[len("struct<row:") : -1]
    return packed.mapInArrow(_reader(exponent, least), f"row {kind}, n_words bigint, runs {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests in place of lists and texts."""
    ordered = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period")))
    )
    longest = F.get(ordered, 0)
    length, period = -longest["size"], longest["period"]
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select(
        "row",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
