"""LM scoring with a log-frequency Bloom filter.

Counts of tokens and of token pairs, those seen once too, are gathered over all training texts by
64-bit hash. The filter holds, for an n-gram of quantised count level q, the entries (n-gram, level)
up to q; a count is read back by probing level after level until one is missing. The filter lies in
segments by hash, as many as the input's bytes ask for, and each segment is sized from its own
entries, so what is gathered grows with the input and no n-gram is left out. Pairs are smoothed by
``WEIGHT`` tokens' worth of the single-token estimate.

No filter is sent to all workers: documents are dealt into blocks by hash, each block asks every
segment for its different n-grams at once (one row of packed keys), and the answers (levels, and
for the single-token baseline exact token counts) come back to the block by its name.

Nulls and odd rows: a null or empty text is its end token alone; a null ``doc_id`` is learned from;
repeated rows count as often as they occur and are scored alike; other columns are left out; without
training texts the baseline divides by the half-count of one unknown token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.sources.scratch import materialize

BITS = 1 << 20
SEGMENTS = 64
SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
PROBES = 4
WEIGHT = 4.0
END = b""
KEPT = 500_000
SEED = 42
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _hashed(texts: list[str | None], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words and its end) and the number of tokens per text.
    The lowest bit of a token's hash is 0."""
    import xxhash

    out, sizes = [], []
    for text in texts:
        words = text.encode("utf-8").lower().split() if text else []
        words.append(END)
        for word in set(words).difference(known):
            if len(known) >= KEPT:
                known.clear()
                break
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word, SEED) & ~1
        out += [known[w] for w in words]
        sizes.append(len(words))
    return np.array(out, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor (an end before the first) and the pairs' hashes, lowest bit 1."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = end
    mixed = (before * _A) ^ (tokens * _B)
    mixed ^= mixed >> np.uint64(29)
    return before, (mixed * _C) | np.uint64(1)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def positions(keys: np.ndarray, level: int, probe: int, bits: int, segments: int) -> np.ndarray:
    """The bit of each key for a level and a probe; all bits of a key are in its segment."""
    part = bits // segments
    x = (keys ^ (np.uint64(level * 2 + 1) * _B)) * _A + np.uint64(probe + 1) * _C
    x ^= x >> np.uint64(31)
    x *= _B
    x ^= x >> np.uint64(29)
    return ((keys >> np.uint64(1)) % np.uint64(segments)) * np.uint64(part) + x % np.uint64(part)


def read_levels(keys: np.ndarray, filter_bits: np.ndarray, lowest: int, bits: int, segments: int, probes: int) -> np.ndarray:
    """The highest level up to which the filter holds every level; ``lowest`` - 1 if none."""
    found = np.full(len(keys), lowest - 1, dtype=np.int64)
    active = np.arange(len(keys))
    level = lowest
    while len(active) and level < 64:
        for probe in range(probes):
            at = positions(keys[active], level, probe, bits, segments)
            active = active[(filter_bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        found[active] = level
        level += 1
    return found


def _expected(levels: np.ndarray, lowest: int) -> np.ndarray:
    """The middle of a level's counts; 0 below the lowest level kept."""
    return np.where(levels >= lowest, np.where(levels == 1, 1.0, 1.5 * 2.0 ** (levels - 1) - 0.5), 0.0)


def _ngrams(texts: list[str | None], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The different n-grams of the texts in order, each token's and each pair's place among them,
    tokens per text, and the end token's hash."""
    tokens, sizes = _hashed(texts, known)
    end = _hashed([None], known)[0][0]
    keys, which = np.unique(np.concatenate([tokens, _pairs(tokens, sizes, end)[1]]), return_inverse=True)
    return keys, which, sizes, end


def _dealt(keys: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each segment with keys, and their places in ``keys`` in order."""
    part = (keys >> np.uint64(1)) % np.uint64(segments)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(segments + 1, dtype=np.uint64))
    for segment in range(segments):
        if cuts[segment] < cuts[segment + 1]:
            yield segment, order[cuts[segment] : cuts[segment + 1]]


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _counter(segments: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy().astype(np.int64))
            cuts = np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == stop:
                    continue
                keys, which, _, _ = _ngrams(batch.column(0).slice(start, stop - start).to_pylist(), known)
                counts = np.bincount(which, minlength=len(keys)).astype("<u4")
                found = [(s, keys[at].tobytes(), counts[at].tobytes()) for s, at in _dealt(keys, segments)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))], ["segment", "keys", "n"])

    return count


def _segment_builder(least: int, probes: int):
    def build(rows: pa.Table) -> pa.Table:
        keys, which = np.unique(_joined(rows["keys"], "<u8"), return_inverse=True)
        counts = np.bincount(which, weights=_joined(rows["n"], "<u4")).astype(np.int64)
        top = _levels(counts)
        bits = -(-max(least, int(np.ceil(top.sum() * probes / np.log(2)))) // 64) * 64
        held = np.zeros(bits, dtype=bool)
        for level in range(1, int(top.max()) + 1):
            chosen = keys[top >= level]
            for probe in range(probes):
                held[positions(chosen, level, probe, bits, 1)] = True
        token = keys & np.uint64(1) == 0
        return pa.table({
            "segment": rows["segment"][:1],
            "octets": [np.packbits(held, bitorder="little").tobytes()],
            "tokens": [keys[token].tobytes()],
            "counts": [counts[token].tobytes()],
            "n": [int(counts[token].sum())],
            "v": [int(token.sum())],
            "entries": [int(top.sum())],
        })

    return build


def build_segments(texts: DataFrame, segments: int, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """The filter by segment: octets, exact counts of the tokens in it, and their sums. A segment
    takes the room of its own entries, and its share of ``bits`` at least. Written once."""
    each = texts.select("text").mapInArrow(_counter(segments), "segment int, keys binary, n binary")
    fields = "segment int, octets binary, tokens binary, counts binary, n bigint, v bigint, entries bigint"
    return materialize(each.groupBy("segment").applyInArrow(_segment_builder(bits // segments, probes), fields), "segments")


def _answer(probes: int):
    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        sizes = pc.binary_length(asked["keys"]).to_numpy().astype(np.int64) // 8
        keys = _joined(asked["keys"], "<u8")
        levels, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if table.num_rows and len(keys):
            octets = _joined(table["octets"], np.uint8)
            levels = read_levels(keys, octets, 1, 8 * len(octets), 1, probes)
            tokens, exact = _joined(table["tokens"], "<u8"), _joined(table["counts"], "<i8")
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, keys), len(tokens) - 1)
                counts = np.where(tokens[at] == keys, exact[at], 0)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        spans = list(zip(cuts[:-1], cuts[1:]))
        token = keys & np.uint64(1) == 0
        return pa.table({
            "block": asked["block"],
            "segment": asked["segment"],
            "levels": pa.array([levels[a:b].astype(np.int8).tobytes() for a, b in spans], pa.binary()),
            "counts": pa.array([counts[a:b][token[a:b]].tobytes() for a, b in spans], pa.binary()),
        })

    return answer


def score(docs: DataFrame, fold: int = 1, by: int = 5, bits: int = BITS, weight: float = WEIGHT) -> DataFrame:
    """Scores of all ``docs``, learned from those outside the fold. ``bits`` is the filter's least
    size."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments, blocks = SEGMENTS + size // SEGMENT_BYTES, 1 + size // BLOCK_BYTES
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by == fold, F.lit(False))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    marked = docs.select(block.alias("block"), "doc_id", "text", out.alias("held_out"))
    tables = build_segments(docs.filter(~out), segments, bits)
    total = tables.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, divisor = int(total.n), float(total.n) + 0.5 * (float(total.v) + 1)
    known: dict[bytes, int] = {}  # each task has its own

    def ask(rows: pa.Table) -> pa.Table:
        keys = _ngrams(rows["text"].to_pylist(), known)[0]
        found = [(s, keys[at].tobytes()) for s, at in _dealt(keys, segments)]
        names = pa.array([rows["block"][0].as_py()] * len(found), pa.int64())
        return pa.table([names, *(pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.binary())))], ["block", "segment", "keys"])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, which, sizes, end = _ngrams(rows["text"].to_pylist(), known)
        levels, exact = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        came = {s: i for i, s in enumerate(answers["segment"].to_pylist())}
        for segment, at in _dealt(keys, segments):
            i = came[segment]
            levels[at] = np.frombuffer(answers["levels"][i].as_py(), np.int8)
            exact[at[keys[at] & np.uint64(1) == 0]] = np.frombuffer(answers["counts"][i].as_py(), "<i8")
        token, pair = which[: len(which) // 2], which[len(which) // 2 :]
        starts = np.cumsum(sizes) - sizes
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[starts] = np.searchsorted(keys, end)
        # the model: estimated counts
        estimate = _expected(levels, 1)
        one, prior, both = (estimate[token] + 0.5) / divisor, estimate[before], estimate[pair]
        model = np.log10((both + weight * one) / (np.maximum(prior, both) + weight))
        # the baseline: exact counts
        base = np.log10((exact + 0.5) / divisor)[token]
        return pa.table({
            "doc_id": rows["doc_id"],
            "held_out": rows["held_out"],
            "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((exact > 0)[token].astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(sizes), n, dtype=np.int64)),
            "base_score": pa.array(np.add.reduceat(base, starts)),
            "score": pa.array(np.add.reduceat(model, starts)),
        })

    # the same grouped documents twice: their shuffle is used again
    asked = marked.groupBy("block").applyInArrow(ask, "block bigint, segment int, keys binary")
    answers = asked.groupBy("segment").cogroup(tables.select("segment", "octets", "tokens", "counts").groupBy("segment"))
    answers = answers.applyInArrow(_answer(PROBES), "block bigint, segment int, levels binary, counts binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return marked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, fields)
