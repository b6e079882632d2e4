"""SimHash near-duplicates: fingerprints within a few bits, joined over segment bit counts.

A fingerprint is embedded as the vector of the bit counts of its 2-bit segments. Two fingerprints
differ in at least as many bits as their vectors differ in Manhattan distance, so pairs within two
bits have vectors within two steps and share a grid point at most one step from either. Each
distinct fingerprint is put on its own point and those one step away (49 of 32 dimensions on
average); points shared by two fingerprints give a pair, which is verified by its differing bits.
Crowded points are never paired: their fingerprints go to the finest grid, of single bits, where
sharing a point within one step is the exact condition, and hang on the point's smallest member.
So the work is linear in the fingerprints whatever the groups are like.

Nulls and odd rows: a null or empty text has no words and fingerprint zero, linked like any other;
repeated rows share a group; a null ``doc_id`` never names a group unless no other id is in it (then
``component_id`` is null); an empty table gives an empty result. ``near_duplicate_groups`` returns
its own columns only, ``keep_one`` the given columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apronflow.llm.components import components
from apronflow.llm.hidden import HIDDEN, hide, show
from apronflow.sources.scratch import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SEGMENT_BITS = 2


def _fingerprinter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest

        def fingerprint(text: str | None) -> int:
            tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            if not tokens:
                return 0
            body = b" ".join(tokens)
            stops = np.cumsum([len(t) + 1 for t in tokens]) - 1
            if len(tokens) <= words:
                spans = [(0, len(body))]
            else:
                starts = np.concatenate(([0], stops[:-1] + 1))
                spans = zip(starts[: len(tokens) - words + 1].tolist(), stops[words - 1 :].tolist())
            hashes = np.array([digest(body[a:b], SEED) for a, b in spans], dtype=np.uint64)
            counts = np.zeros(64, dtype=np.int64)
            for at in range(0, len(hashes), 1 << 16):
                octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            ones = np.packbits(2 * counts > len(hashes), bitorder="little")
            return int(ones.view(np.int64)[0])

        for batch in batches:
            *others, texts = batch.columns
            prints = [fingerprint(x) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*others, pa.array(prints, pa.int64())], [*batch.schema.names[:-1], "print"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id or other ``keys``, print): the 64-bit SimHash of every whole text as a signed number."""
    kinds = [f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys]
    return docs.select(*keys, "text").mapInArrow(_fingerprinter(words), ", ".join([*kinds, "print bigint"]))


def _points(prints: DataFrame, bits: int) -> DataFrame:
    """(point, print): the grid points within one step of each print's vector of bit counts.

    With segments of ``bits`` (1 or 2) the counts are packed into the places of the segments.
    """
    if bits == 1:
        flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        near = F.transform(flips, lambda f: F.col("print").bitwiseXOR(f))
        return prints.select("print", F.explode_outer(F.concat(F.array("print"), near)).alias("point"))
    # the sum of a segment's two bits: both set give 2, one gives 1
    even, odd = "(print & 6148914691236517205)", "(shiftrightunsigned(print, 1) & 6148914691236517205)"
    places = prints.withColumn("vector", F.expr(f"({even} ^ {odd}) | shiftleft({even} & {odd}, 1)"))
    up = "filter(sequence(0, 62, 2), i -> (shiftright(vector, i) & 3) < 2)"
    down = "filter(sequence(0, 62, 2), i -> (shiftright(vector, i) & 3) > 0)"
    # a count fits its two bits before and after the step, so xor of two values is the step itself
    step = lambda by: f"i -> vector ^ shiftleft((shiftright(vector, i) & 3) ^ ((shiftright(vector, i) & 3) {by} 1L), i)"
    near = f"concat(array(vector), transform({up}, {step('+')}), transform({down}, {step('-')}))"
    return places.select("print", F.explode_outer(F.expr(near)).alias("point"))


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def print_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct prints within two bits of each other into the same
    components; every link is itself within two bits.

    ``prints`` holds distinct prints and is read several times: give a written table.
    """
    points = _points(prints, SEGMENT_BITS)
    shared = points.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
    shared = materialize(shared.filter("n > 1"), "points")
    pairs = shared.filter("n = 2").select("a", "b").filter(_differing(F.col("a"), F.col("b")) <= MAX_BITS)
    crowded = shared.filter("n > 2").select("point")
    crowd = points.join(crowded, "point", "left_semi").select("print").distinct()
    fine = materialize(_points(materialize(crowd, "crowd"), 1), "fine")
    stars = fine.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a")).filter("n > 1")
    hung = fine.join(stars.select("point", "a"), "point").select("a", F.col("print").alias("b")).filter("a <> b")
    return pairs.union(hung.filter(_differing(F.col("a"), F.col("b")) <= MAX_BITS)).distinct()


def near_duplicate_groups(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id linked), per row."""
    rows = materialize(fingerprints(docs, words), "prints")
    prints = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(print_links(prints.select("print")))
    linked = materialize(prints.join(labels.withColumnRenamed("node", "print"), "print"), "linked")
    firsts = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = linked.join(firsts, "label").select("print", "component_id")
    # prints without a link stand for themselves
    every = prints.join(named.withColumn("_named", F.lit(True)), "print", "left")
    owner = F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("first"))
    owners = every.select("print", owner.alias("component_id"))
    return rows.join(owners, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group, that of the smallest ``doc_id`` (then of the smallest fingerprint and
    digest of its columns); where an id repeats with other texts, each row counts for its own group.
    Rows without an id all stay and stand for no group that has one with an id."""
    used = ("doc_id", "text")
    hashed = [c if c in used else f"{HIDDEN}.`{c}`" for c, kind in docs.dtypes if "map<" not in kind]
    marked = hide(docs, *used).withColumn("_digest", F.xxhash64(*hashed))
    rows = materialize(fingerprints(marked.filter("doc_id IS NOT NULL"), words, ("doc_id", "_digest")), "prints")
    # rows without an id still link those with one
    every = rows.select("print").union(fingerprints(docs.filter("doc_id IS NULL"), words).select("print"))
    labels = components(print_links(materialize(every.distinct(), "distinct")))
    named = rows.join(labels.withColumnRenamed("node", "print"), "print", "left")
    least = named.groupBy(F.coalesce("label", "print")).agg(F.min(F.struct("doc_id", "print", "_digest")).alias("x"))
    found = marked.join(least.select("x.doc_id", "x._digest"), ["doc_id", "_digest"], "left_semi")
    # rows alike in all columns share a digest
    one = Window.partitionBy("doc_id", "_digest").orderBy("_digest")
    kept = found.withColumn("_row", F.row_number().over(one)).filter("_row = 1")
    return show(kept, docs.columns, used, []).union(docs.filter("doc_id IS NULL"))
