"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its target weight times the wanted size of the mix, over
its own size (in code points of text). A document's number of copies is the smallest k whose
Poisson probability of k or fewer reaches a uniform number hashed from the seed and the document,
so it is the same on every run. Rates above ``PIECE`` are sums of independent smaller ones. The
copies are spread by hash and sorted by hash inside each part: a global shuffle in one exchange.

Nulls and odd rows: a null source is a source of its own; a null text counts no code points but its
document is drawn at its source's rate; a source of only empty texts has rate 1; a source without a
given weight has weight 0 and so no copies; repeated rows are drawn alike, each on its own; a null
``doc_id`` is drawn by its text; ``copy`` and ``rate`` replace columns of that name; all other columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apronflow.llm.hidden import hide, show
from apronflow.sources.scratch import materialize

ALPHA = 0.5
SEED = 17
PIECE = 32.0
USED = ("doc_id", "text", "source")


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, size: float = 1.0) -> DataFrame:
    """(source, rate). Weights are given per source, or are the sources' sizes to the power
    ``alpha``; the mix has ``size`` times the input's code points on average."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(n).alias("chars"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(alpha)))
    else:
        found = F.lit(0.0)
        for source, weight in weights.items():
            found = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(found)
        weighted = sizes.withColumn("weight", found)
    written = materialize(weighted, "weights")
    total = written.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    if not total.weight:
        return written.select("source", F.lit(1.0).alias("rate"))
    rate = F.col("weight") / total.weight * size * total.chars / F.col("chars")
    return written.select("source", F.when(F.col("chars") > 0, rate).otherwise(1.0).alias("rate"))


def uniform(seed: int, piece: str = "0") -> str:
    """SQL of a number in [0, 1) with 52 bits from the seed, the piece and the document."""
    key = f"concat('{seed}-', cast({piece} as string), '-', coalesce(cast(doc_id as string), md5(coalesce(text, ''))))"
    return f"cast(conv(substring(md5({key}), 1, 13), 16, 10) as bigint) / 4503599627370496D"


def with_copies(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``rate`` and ``copies``."""
    return show(_drawn(hide(docs, *USED), rates, seed), docs.columns, USED, ["rate", "copies"])


def _drawn(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Hidden ``docs`` with ``rate`` and ``copies``."""
    # per source: how many pieces, and the piece's cumulative probabilities up to the last that
    # differs from 1 (rate 32 has none beyond 150)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    table = F.expr("""transform(aggregate(sequence(1, 150), array(struct(exp(-piece) as p, exp(-piece) as c)),
        (s, k) -> concat(s, array(struct(element_at(s, -1).p * piece / k as p,
            element_at(s, -1).c + element_at(s, -1).p * piece / k as c)))), x -> x.c)""")
    tables = rates.withColumn("pieces", pieces).withColumn("piece", F.col("rate") / F.col("pieces")).withColumn("table", table)
    # a written table: its size tells whether it can be sent to all tasks
    tables = materialize(tables.select(F.col("source").alias("_source"), "rate", "pieces", "table"), "rates")
    joined = docs.join(tables, F.col("source").eqNullSafe(F.col("_source")))
    draws = joined.withColumn("_draws", F.expr(f"transform(sequence(1, pieces), j -> {uniform(seed, 'j')})"))
    copies = F.expr("aggregate(_draws, 0, (n, u) -> n + size(filter(table, c -> c <= u)))")
    return draws.select(*docs.columns, "rate", copies.alias("copies"))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mix: every document as often as drawn, with ``copy`` (from 1) and ``rate``, in a global
    shuffle."""
    drawn = _drawn(hide(docs, *USED), source_rates(docs, weights, alpha, size), seed).filter("copies > 0")
    copies = drawn.withColumn("copy", F.explode_outer(F.expr("sequence(1, copies)")))
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.xxhash64("text"), "copy")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = copies.withColumn("_place", place).repartition(n, "_place").sortWithinPartitions("_place")
    return show(spread, docs.columns, USED, ["copy", "rate"])


ORACLE = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, * FROM documents
), sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM docs GROUP BY source
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN pow(chars, {ALPHA}) / sum(pow(chars, {ALPHA})) OVER () * sum(chars) OVER () / chars ELSE 1 END AS rate
  FROM sizes
), parts AS (
  SELECT source, rate, ceil(greatest(1, rate / {PIECE}))::INT AS pieces, rate / ceil(greatest(1, rate / {PIECE})) AS piece FROM rates
), cumulative AS (
  SELECT source, k, sum(exp(-piece + k * ln(piece) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT *, unnest(range(0, 151)) AS k FROM parts)
), draws AS (
  SELECT r, d.source, rate, ('0x' || substr(md5('{SEED}-' || j || '-' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT docs.*, rate, unnest(range(1, pieces + 1)) AS j FROM docs JOIN parts ON docs.source IS NOT DISTINCT FROM parts.source) d
), copies AS (
  SELECT r, any_value(rate) AS rate, count(*) FILTER (c <= u) AS n
  FROM draws JOIN cumulative ON draws.source IS NOT DISTINCT FROM cumulative.source GROUP BY r
)
SELECT doc_id, text, lang, source, n_chars, round(copies.rate, 6) AS rate, unnest(range(1, n + 1))::INT AS copy
FROM copies JOIN docs USING (r)
"""
