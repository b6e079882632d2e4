"""Exact duplicates by a content sort.

Texts are put in order by (first ``HEAD`` characters, digest, whole text, doc_id). Splitters from a
sample cut that order into slices; as they end with the id, a text held by a third of all rows is cut
as well. Each slice is sorted by Spark's spilling sort, equal texts lie next to each other, and
whole neighbouring texts are compared; the digest only bounds the size of splitters and never decides.
A run of equal texts that crosses slices is put together from the runs at the slices' edges (two a slice).
The text is shuffled once; only DataFrame functions are used.

Nulls and odd rows: a null text is the empty text; a null ``doc_id`` is below every other, and a group
without any id has ``keep_id`` null; exactly one row of a group stays, also where its largest id
is repeated; other columns are carried whole and may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apronflow.sources.scratch import materialize

HEAD = 32
# sampled keys per slice: a slice holds its share of bytes within about a fifth
OVERSAMPLE = 32
SEED = 42

RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]

ORACLE = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` packed in one, so that their names can't clash; text, id and sort key."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row"),
        F.col("text").alias("body"),
        F.col("doc_id").cast("long").alias("id"),
    )
    text = F.coalesce("body", F.lit(""))
    keyed = rows.withColumns({"head": F.substring(text, 1, HEAD), "digest": F.sha2(text, 256)})
    sign = F.lit(-(2**63)).cast("long")
    place = F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(F.col("id").bitwiseXOR(sign)), 16, "0")), F.lit("0"))
    return keyed.withColumn("key", F.concat(F.rpad("head", HEAD, "\0"), "digest", place))


def _splitters(docs: DataFrame, slices: int) -> list[str]:
    """At most ``slices`` - 1 keys of about a hundred bytes, evenly spaced by the bytes of the texts in
    a sample of about ``OVERSAMPLE`` keys a slice, whatever the texts' lengths."""
    share = min(1.0, OVERSAMPLE * slices / max(1, docs.count()))
    sample = _keyed(docs.sample(share, seed=SEED), ["doc_id"]).select("key", (F.octet_length(F.coalesce("body", F.lit(""))) + 64).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(before, F.lit(0)) * slices / F.sum("bytes").over(Window.partitionBy(F.lit(0))))
    firsts = sample.select("key", part.alias("part")).groupBy("part").agg(F.min("key").alias("key"))
    return sorted((r.key for r in firsts.filter("part > 0").collect()), key=lambda k: k.encode())


def _slice(splitters: list[str]) -> tuple[Column, Column]:
    """The number of splitters up to a row's key, looked up in two levels: among every ``width``-th of
    them (column ``group``), then in the group found."""
    if not splitters:
        return F.lit(0), F.lit(0)
    width = max(1, isqrt(len(splitters)))
    below = lambda s: s <= F.col("key")
    first = (F.greatest(F.col("group"), F.lit(1)) - 1) * width
    inside = F.size(F.filter(F.slice(F.lit(splitters), first + 1, width), below))
    return F.size(F.filter(F.lit(splitters[::width]), below)), first + inside


def _pieces(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Every row with its slice and its run of equal texts inside the slice; the run's rows and
    largest id; and as ``edge`` the text itself of a slice's first and last row."""
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group, place = _slice(_splitters(docs, slices))
    placed = _keyed(docs, columns).withColumn("group", group).withColumn("slice", place)
    cut = placed.drop("key", "group").repartitionById(slices, F.col("slice"))
    cut = cut.withColumn("text", F.coalesce("body", F.lit("")))
    content = Window.partitionBy("slice").orderBy("head", "digest", "text", F.asc_nulls_first("id"))
    near = cut.withColumns({"before": F.lag("text").over(content), "after": F.lead("text").over(content)})
    marked = near.select(
        *cut.columns,
        (~F.col("before").eqNullSafe(F.col("text"))).alias("starts"),
        (~F.col("after").eqNullSafe(F.col("text"))).alias("ends"),
        F.col("before").isNull().alias("first"),
        F.col("after").isNull().alias("last"),
    )
    numbered = marked.withColumn("run", F.sum(F.col("starts").cast("long")).over(content))
    edge = F.when(F.col("first") | F.col("last"), F.col("text")).alias("edge")
    carried = ["row", "body"] if "text" in columns else ["row"]
    narrow = numbered.select(*carried, "id", "digest", "slice", "run", "ends", "first", "last", edge)
    run = Window.partitionBy("slice", "run")
    return narrow.withColumns({"n": F.count(F.lit(1)).over(run), "top": F.max("id").over(run)})


def _crossing(pieces: DataFrame) -> DataFrame:
    """(slice, run) of the runs at slices' edges with the rows, largest id and last slice of the whole
    group they belong to: at most two rows a slice."""
    edges = materialize(pieces.filter(F.col("first") | F.col("last")).select("slice", "run", "first", "last", "edge", "n", "top"), "edges")
    in_order = Window.partitionBy(F.lit(0)).orderBy("slice")
    order = materialize(
        edges.filter("last").select(
            "slice", F.lag("slice").over(in_order).alias("previous"), F.lag("run").over(in_order).alias("previous_run")
        ),
        "slice-order",
    )
    left = edges.filter("last").select(F.col("slice").alias("previous"), F.col("edge").alias("left"))
    right = edges.filter("first").select("slice", F.col("edge").alias("right"))
    compared = order.join(right, "slice").join(left, "previous", "left")
    goes_on = F.coalesce(F.col("left") == F.col("right"), F.lit(False))
    start = F.when(~goes_on, F.struct("slice", F.lit(1).cast("long").alias("run"))).when(
        F.col("previous_run") > 1, F.struct(F.col("previous").alias("slice"), F.col("previous_run").alias("run"))
    )
    roots = compared.select("slice", "previous_run", start.alias("start"))
    roots = roots.select("slice", F.last("start", ignorenulls=True).over(in_order).alias("root"))
    runs = edges.groupBy("slice", "run").agg(F.max("n").alias("n"), F.max("top").alias("top"))
    own = F.when(F.col("run") == 1, F.col("root")).otherwise(F.struct("slice", "run"))
    rooted = runs.join(roots, "slice").withColumn("root", own)
    whole = Window.partitionBy("root")
    return rooted.select(
        "slice", "run",
        F.sum("n").over(whole).alias("all_rows"), F.max("top").over(whole).alias("all_top"),
        F.max("slice").over(whole).alias("last_slice"),
    )


def exact_duplicates(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``row`` (the named columns of ``docs``, all by default) and, for its text: keep_id (largest id
    of the equal texts), group_size, kept (true for one row of the group, of the largest id) and
    text_sha256."""
    columns = columns or docs.columns
    pieces = materialize(_pieces(docs, columns), "pieces")
    crossing = materialize(_crossing(pieces), "crossing")
    known = pieces.join(crossing, ["slice", "run"], "left")
    fields = [F.col("body").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns]
    return known.select(
        F.struct(*fields).alias("row"),
        F.coalesce("all_top", "top").alias("keep_id"),
        F.coalesce("all_rows", "n").alias("group_size"),
        (F.col("ends") & F.coalesce(F.col("last_slice") == F.col("slice"), F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text."""
    return exact_duplicates(docs).filter("kept").select("row.*")
