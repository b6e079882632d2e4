"""The named queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apronflow.llm import bpe, classifier, exact, licenses, lm, mixing, ranked, rules, runs, search, simhash, urls, warc
from apronflow.sources.scratch import scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_read(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.filter("doc_id % 20 = 0"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    net = classifier.fit(docs, _read(spark, sf_dir, "labels"))
    return classifier.classify(docs, net).select("doc_id", *classifier.RESULTS)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.quality_rules(docs, _read(spark, sf_dir, "labels")).select("doc_id", *rules.RESULTS)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("url")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", *[c for c in licenses.NAMES if c != "spans"])


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages).select("page_id", *urls.RESULTS)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", *bpe.digests(decoded))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(_read(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact.exact_duplicates(_read(spark, sf_dir, "documents"), ["doc_id"])
    return marked.select("row.doc_id", *exact.RESULTS)


def _with_repeated_tail(docs: DataFrame) -> DataFrame:
    """The stated input of ``op12_periodic_runs``: in a tenth of the documents the words from some word on
    repeat its first ones."""
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, chosen))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    docs = docs.withColumns({"n": n, "a": F.when(n > 0, g % n).cast("int"), "g": g})
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    repeated = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail)
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_repeated_tail(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.digests(runs.periodic_runs(docs, ["doc_id"])).select("row.doc_id", "*").drop("row")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranked.search(index, _read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_top_k, op3_quality_classifier, op4_quality_rules, op5_lm_scores, op6_warc, op7_licenses, op8_url_filter,
        op9_bpe, op10_mixing, op11_exact_dedup, op12_periodic_runs, op13_ranked_search,
    )
}

ORACLES = {
    "op4_quality_rules": rules.ORACLE, "op10_mixing": mixing.ORACLE, "op11_exact_dedup": exact.ORACLE, "op13_ranked_search": ranked.ORACLE,
}
