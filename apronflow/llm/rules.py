"""Quality rules: counts per text, then a hashed n-gram likelihood ratio. DataFrame functions only.

The n-grams are a text's whole words and its pairs of neighbouring words, hashed into ``BUCKETS``
buckets. A trusted target (documents labelled good) and the raw corpus (every document, its counts
scaled to the target's total) each give a multinomial over the buckets, smoothed by the same count,
so an n-gram that the corpus hardly knows weighs next to nothing. A text's score is the mean log
ratio of its n-grams; one fixed threshold decides every text.

Nulls and odd rows: a null text counts as empty; a text without n-grams scores 0; without a target every text does; a row with a null
``doc_id`` is scored but never part of the target; repeated rows count as often as they occur;
other columns pass through, whatever their names, unless they carry the name of a result column, which
replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.llm.hidden import hide, show
from apronflow.sources.scratch import materialize

BUCKETS = 65_521
SMOOTHING = 32
THRESHOLD = -0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*COUNTS, "base_failed", "llr", "kept"]

# buckets of a word by its hash, and of a pair by its words' hashes
_WORD = f"cast(pmod({{0}}, {BUCKETS}) as int)"
_PAIR = f"cast(pmod({{0}} * 31L + {{1}}, {BUCKETS}L) as int)"
_CODES = "transform(_words, w -> hash(w))"
_GRAMS = f"""concat(transform(_codes, h -> {_WORD.format('h')}),
    zip_with(slice(_codes, 1, greatest(size(_codes) - 1, 0)), slice(_codes, 2, greatest(size(_codes) - 1, 0)),
        (a, b) -> {_PAIR.format('a', 'b')}))"""
SCALE = 10_000


def words(text: Column) -> Column:
    """Words of a text in order: runs of anything but space, tab and line or page ends."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts, and the words in ``_words``; for hidden ``docs`` (see ``judge``).

    A word is repeated if one of the 3-word windows that hold it occurs twice or more. Windows are
    compared by a 64-bit hash. Texts without a repeated window are told by their count of distinct
    ones; in others equal windows are found by sorting (hash, position), so a long text costs
    n log n.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.drop(*COUNTS).withColumns({"_words": words(F.col(text)), "_lines": lines})
    counted = first.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    ).drop("_lines")
    windows = counted.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))")).withColumn(
        "_windows",
        F.expr("""transform(slice(_hashes, 1, greatest(size(_hashes) - 2, 0)),
            (h, i) -> xxhash64(h, _hashes[i + 1], _hashes[i + 2]))"""),
    )
    placed = F.expr("""if(size(array_distinct(_windows)) = size(_windows), null,
        sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))))""")
    again = F.expr("""sort_array(transform(filter(_placed, (e, k) ->
        e.h <=> get(_placed, k - 1).h or e.h <=> get(_placed, k + 1).h), e -> e.i))""")
    # a window covers three words, less those that the window before it covers
    covered = F.expr("""coalesce(aggregate(_again, struct(-3 as last, 0L as n),
        (s, p) -> struct(p as last, s.n + least(3, p - s.last) as n), s -> s.n), 0L)""")
    return (
        windows.withColumn("_placed", placed)
        .withColumn("_again", again)
        .withColumn("n_repeat_words", covered)
        .drop("_hashes", "_windows", "_placed", "_again")
    )


def bucket_weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, weight) of every bucket: the log ratio of target and raw probability in units of 1 / ``SCALE``.

    ``target`` holds the ``doc_id`` of trusted documents. It may be as long as the corpus, so it is
    always merged with the documents, never broadcast.
    """
    spark = docs.sparkSession
    trusted = target.select("doc_id").dropna().distinct().withColumn("_trusted", F.lit(1))
    marked = docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left")
    split = marked.select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), words(F.col("text")).alias("_words"))
    coded = split.select("_trusted", F.expr(_CODES).alias("_codes"))
    # outer: a plain explode infers a filter on its array, which would split every text again
    each = coded.select("_trusted", F.explode_outer(F.expr(_GRAMS)).alias("bucket")).filter("bucket IS NOT NULL")
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_trusted").alias("good"))
    counts = materialize(counts, "buckets")
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0, ["raw", "good"])
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    expected = F.col("raw").cast("double") * F.lit(float(total.good)) / F.lit(float(max(total.raw, 1)))
    ratio = F.log((F.col("good") + float(SMOOTHING)) / (expected + float(SMOOTHING)))
    return filled.select("bucket", F.round(ratio * SCALE).cast("int").alias("weight"))


def _as_array(weights: DataFrame) -> Column:
    """The weights as one constant array: 65,521 numbers, whatever the size of the corpus."""
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"].cast("string"))
    return F.split(F.lit(weights.agg(F.array_join(numbers, ",")).first()[0]), ",").cast("array<int>")


def judge(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``llr`` and ``kept``; no shuffle."""
    table = _as_array(weights)
    counted = with_counts(hide(docs, "text"))
    total = F.aggregate(F.expr(_GRAMS), F.lit(0).cast("long"), lambda s, g: s + F.get(table, g))
    # whole units: the order of the sum makes no difference
    mean = (total.cast("double") / F.greatest(2 * F.size("_codes") - 1, F.lit(1))).cast("long")
    scored = (
        counted.withColumn("_codes", F.expr(_CODES))
        .withColumn("llr", mean / F.lit(float(SCALE)))
        .drop("_codes", "_words")
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    # the id is never negative; being an id of this plan, it keeps filters on the results above the
    # counting: pushed below, they would count every word anew inside other functions
    here = F.monotonically_increasing_id() >= 0
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & here)
    return show(judged, docs.columns, ("text",), RESULTS)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Judge ``docs`` with weights from all of them, documents labelled good being the target."""
    target = labels.filter("quality = 1")
    return judge(docs, bucket_weights(docs.select("doc_id", "text"), target), threshold)


def _murmur(text: str) -> str:
    """SQL of the 32-bit Murmur3 hash, x86 form with single trailing bytes, of a short string."""
    word = 4294967296
    turn = lambda x, n: f"((({x}) * {2**n}) % {word} + (({x}) // {2 ** (32 - n)}))"
    codes = f"[('0x' || substr(hex({text}), 2 * i - 1, 2))::UBIGINT for i in range(1, strlen({text}) + 1)]"
    blocks = (
        f"([c[4*j+1] + c[4*j+2] * 256 + c[4*j+3] * 65536 + c[4*j+4] * 16777216 for j in range(0, len(c) // 4)]"
        f" || [if(x > 127, x + {word - 256}, x) for x in c[(len(c) // 4) * 4 + 1:]])"
    )
    mixed = turn(f"(k::UHUGEINT * 3432918353) % {word}", 15)
    step = turn(f"xor(h::UBIGINT, ((({mixed})::UHUGEINT * 461845907) % {word})::UBIGINT)::UHUGEINT", 13)
    folded = f"list_reduce([42::UBIGINT] || {blocks}, lambda h, k: ((({step}) * 5 + 3864292196) % {word})::UBIGINT)"
    a = f"xor({folded}, len(c)::UBIGINT)"
    return f"""(SELECT if(v >= 2147483648, v::BIGINT - {word}, v::BIGINT) FROM (SELECT xor(z, z // 65536) AS v FROM (SELECT ((xor(y, y // 8192)::UHUGEINT * 3266489909) % {word})::UBIGINT AS z
      FROM (SELECT ((xor(x, x // 65536)::UHUGEINT * 2246822507) % {word})::UBIGINT AS y
      FROM (SELECT {a} AS x FROM (SELECT {codes} AS c))))))"""


ORACLE = f"""
WITH w AS (
  SELECT rowid AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), base AS (
  SELECT *, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM w
), tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS t
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, t) > 1
), cover AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r
), places AS (
  SELECT r, doc_id, ws[i] AS a, if(i > 1, ws[i-1], NULL) AS b
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), codes AS (SELECT a, {_murmur("a")} AS h FROM (SELECT DISTINCT a FROM places)
), grams AS (
  SELECT r, doc_id, (h % {BUCKETS} + {BUCKETS}) % {BUCKETS} AS g FROM places JOIN codes USING (a)
  UNION ALL
  SELECT r, doc_id, ((before.h * 31 + own.h) % {BUCKETS} + {BUCKETS}) % {BUCKETS}
  FROM places JOIN codes own ON own.a = places.a JOIN codes before ON before.a = places.b
), counts AS (
  SELECT g, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good
  FROM grams GROUP BY g
), total AS (SELECT coalesce(sum(raw), 0) AS raw, coalesce(sum(good), 0) AS good FROM counts),
weights AS (
  SELECT g, round(ln((counts.good + {SMOOTHING}) / (counts.raw::DOUBLE * total.good::DOUBLE / greatest(total.raw, 1)::DOUBLE + {SMOOTHING}))
              * {SCALE})::BIGINT AS weight
  FROM counts, total
), scores AS (
  SELECT r, trunc(sum(weight)::DOUBLE / count(*)) / {SCALE}.0::DOUBLE AS llr FROM grams JOIN weights USING (g) GROUP BY r
), judged AS (
  SELECT base.*, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    coalesce(llr, 0.0) AS llr
  FROM base LEFT JOIN cover USING (r) LEFT JOIN scores USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, llr,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND llr >= {THRESHOLD} AS kept
FROM judged
"""
