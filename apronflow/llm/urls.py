"""URL filters: rules for hosts and paths, then the ratio of two character language models.
DataFrame functions only.

Models of order ``ORDER`` are counted over the URLs that the rules allow and over those that they
block. Characters are mapped to an alphabet of 49 symbols, so a model is a table of 49 ** 3 numbers
whatever the corpus. The probability of a symbol mixes the counts after the longest context with
those after shorter ones: each order's estimate is the prior of the next (weight ``PRIOR``). A URL's
score is the log ratio of its two probabilities per symbol. The threshold lies between the mean
scores of allowed and blocked URLs, as many standard deviations from either.

Nulls and odd rows: a null URL, or one without ``://``, has empty host and path and matches no rule;
an empty or null URL scores 0; if either model has no URLs every score and the threshold are 0, and
all are allowed; repeated rows count as often as they occur; other columns pass through, those named
like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.llm.hidden import hide, show
from apronflow.sources.scratch import materialize

# fixed values: verdict, host, path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#%:~"
OTHER = len(LETTERS) + 1
SYMBOLS = len(LETTERS) + 2  # 0 stands before the first character
PRIOR = 5.0
RESULTS = ["host", "path", "rule", "verdict", "score"]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, whole.substr(at + 3, F.length(whole))).otherwise("")
    host = _lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.drop("host", "path").withColumn("host", host).withColumn("path", path)


def _ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for found, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, found).otherwise(verdict)
    return rule, verdict


def _codes(url: str) -> str:
    body = f"translate(coalesce({url}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""transform(filter(split({body}, ''), c -> c <> ''),
        c -> if(locate(c, '{LETTERS}') > 0, locate(c, '{LETTERS}'), {OTHER}))"""


_PLACES = f"""transform(_codes, (c, i) -> (coalesce(get(_codes, i - 2), 0) * {SYMBOLS}
    + coalesce(get(_codes, i - 1), 0)) * {SYMBOLS} + c)"""


def model(pages: DataFrame) -> DataFrame:
    """(place, weight): the log ratio of every symbol after every two symbols, to 6 decimals.

    ``pages`` has ``url`` and the rules' ``_ruled``. Counts per place are summed before the shuffle.
    """
    spark = pages.sparkSession
    codes = pages.filter("_ruled IS NOT NULL").select((F.col("_ruled") == "allow").cast("int").alias("good"), F.expr(_codes("url")).alias("_codes"))
    places = codes.select("good", F.explode_outer(F.expr(_PLACES)).alias("place")).filter("place IS NOT NULL")
    counts = places.groupBy("place").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    counts = materialize(counts, "symbols")
    every = spark.range(SYMBOLS**3).select(F.col("id").cast("int").alias("place"))
    table = every.join(counts, "place", "left").na.fill(0, ["good", "bad"])
    table = table.withColumn("c", F.col("place") % SYMBOLS).withColumn("ab", F.expr(f"place div {SYMBOLS}")).withColumn("b", F.expr(f"place div {SYMBOLS} % {SYMBOLS}"))
    table = table.withColumn("bc", F.col("b") * SYMBOLS + F.col("c"))

    def total(side: str, *by: str) -> DataFrame:
        return table.groupBy(*by).agg(F.sum(side).alias("_".join([side, *by, "n"])))

    mixed = table
    for side in ("good", "bad"):
        for by in (["c"], ["b"], ["bc"], ["ab"]):
            mixed = mixed.join(total(side, *by), by)
        whole = table.agg(F.sum(side).alias(f"{side}_n"))
        mixed = mixed.withColumn(f"{side}_n", F.lit(whole.first()[0]))
        p0 = (F.col(f"{side}_c_n") + PRIOR / SYMBOLS) / (F.col(f"{side}_n") + PRIOR)
        p1 = (F.col(f"{side}_bc_n") + PRIOR * p0) / (F.col(f"{side}_b_n") + PRIOR)
        p2 = (F.col(side) + PRIOR * p1) / (F.col(f"{side}_ab_n") + PRIOR)
        mixed = mixed.withColumn(f"log_{side}", F.log(p2))
    both = (F.col("good_n") > 0) & (F.col("bad_n") > 0)
    return mixed.select("place", F.when(both, F.round(F.col("log_good") - F.col("log_bad"), 6)).otherwise(0.0).alias("weight"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score."""
    rule, verdict = _ruled(rules)
    ruled = with_parts(hide(pages, "url")).withColumn("rule", rule).withColumn("_ruled", verdict)
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("place", "weight"))), lambda x: x["weight"].cast("string"))
    text = model(ruled).agg(F.array_join(numbers, ",")).first()[0]
    table = F.split(F.lit(text), ",").cast("array<double>")
    total = F.aggregate(F.expr(_PLACES), F.lit(0.0), lambda s, p: s + F.get(table, p))
    scored = ruled.withColumn("_codes", F.expr(_codes("url"))).withColumn(
        "score", F.round(total / F.greatest(F.size("_codes"), F.lit(1)), 6)
    )
    scored = scored.drop("_codes")
    sides = scored.groupBy("_ruled").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))
    found = {r["_ruled"]: r for r in sides.filter("_ruled IS NOT NULL").collect()}
    threshold = 0.0
    if len(found) == 2:
        a, b = found["allow"], found["block"]
        spread = a.spread + b.spread
        threshold = (a["mean"] * b.spread + b["mean"] * a.spread) / spread if spread else (a["mean"] + b["mean"]) / 2
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return show(scored.withColumn("verdict", F.coalesce("_ruled", by_model)), pages.columns, ("url",), RESULTS)
