"""The likelihood ratio reads whole words."""

import re

from pyspark.sql import functions as F

from apronflow.llm import rules


def test_changed_words_lower_the_ratio(spark, folder):
    table = spark.read.parquet(folder + "/documents.parquet")
    labels = spark.read.parquet(folder + "/labels.parquet")
    weights = rules.bucket_weights(table.select("doc_id", "text"), labels.filter("quality = 1"))
    good = table.join(labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "text")
    # every word of five or more characters keeps its two first and last characters only
    changed = good.withColumn("text", F.regexp_replace("text", r"(\S{2})\S+?(\S{2})(?=\s|$)", "$1qq$2"))
    before = {r.doc_id: r.llr for r in rules.judge(good, weights).collect()}
    after = {r.doc_id: r.llr for r in rules.judge(changed, weights).collect()}
    # words that no text has weigh next to nothing, so most texts above 0 fall; not each of so few texts does
    above = [d for d in before if before[d] > 0]
    assert len(above) > 40 and sum(after[d] < before[d] for d in above) > 0.9 * len(above)
    assert sum(after[d] for d in above) < 0.8 * sum(before[d] for d in above)
    assert all(after[d] != before[d] for d in before)


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(folder + "/documents.parquet")
    labels = spark.read.parquet(folder + "/labels.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    judged = rules.quality_rules(table, labels.filter("not out")).join(labels.filter("out"), "doc_id").filter("not base_failed")
    found = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert found.get((1, True), 0) > 0.95 * (found.get((1, True), 0) + found.get((1, False), 0))
    assert found.get((0, False), 0) >= 0.9 * (found.get((0, True), 0) + found.get((0, False), 0))


def test_score_is_the_mean_log_ratio(spark):
    """Against plain Python, with words told apart by text, not by bucket."""
    import collections
    import math

    texts = {1: "a b a c", 2: "a b", 3: "", 4: None, 5: "d", 6: "a d é é"}
    table = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 0)], "doc_id LONG, quality INT")

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [*w, *zip(w, w[1:])]

    raw, good = collections.Counter(), collections.Counter()
    for i, text in texts.items():
        raw.update(grams(text))
        good.update(grams(text) if i in (1, 5) else [])
    share = sum(good.values()) / sum(raw.values())
    for r in rules.quality_rules(table, labels).collect():
        units = [round(10_000 * math.log((good[g] + rules.SMOOTHING) / (raw[g] * share + rules.SMOOTHING))) for g in grams(r.text)]
        assert abs(r.llr - (sum(units) / len(units) / 10_000 if units else 0)) < 1.01e-4
