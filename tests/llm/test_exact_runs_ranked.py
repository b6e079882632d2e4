"""Exact duplicates, periodic runs and ranked search against plain Python on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from apronflow.llm import exact, queries, ranked, runs

LONG = "".join(f"word{i % 977} of{i % 31} " for i in range(20_000))
TEXTS = [None, "", " \n\t", "a", "A", "a ", "é", "only once", LONG, LONG, LONG + "x", "the gate the gate the gate the gate", "x " * 40, "one two three"]
# names that the operators use inside, and those of their results
CLASHING = [
    "row", "body", "id", "head", "digest", "key", "group", "slice", "run", "starts", "ends", "first", "last", "edge", "n", "top", "keep_id",
    "group_size", "kept", "text_sha256", "runs", "n_words", "collapsed", "query", "rank", "score", "term", "shard", "block", "docs", "words",
]


def table(spark, rows):
    schema = ", ".join(["doc_id LONG", "text STRING", *[f"`{c}` STRING" for c in CLASHING]])
    return spark.createDataFrame([(i, t, *[f"{c}{i}" for c in CLASHING]) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def rows():
    found = [(i, t) for i, t in enumerate(TEXTS)] + [(40 + i % 30, "copy") for i in range(300)] + [(3, "a"), (None, "a"), (None, "copy"), (None, "no id"), (None, "no id"), (None, None)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def exact_brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        largest = max(known, default=None)
        stays = False
        for i in ids:
            kept = i == largest and not stays
            stays |= kept
            out.append((i, largest, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("oversample", [1, 500])
def test_exact_duplicates(monkeypatch, docs, rows, oversample):
    # many sampled keys make slices that cut the group of copies several times
    monkeypatch.setattr(exact, "OVERSAMPLE", oversample)
    found = exact.exact_duplicates(docs).select("row.doc_id", *exact.RESULTS).collect()
    assert in_order(found) == in_order(exact_brute(rows))
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in rows})
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_exact_duplicates_of_one_text_and_of_none(spark, docs):
    same = table(spark, [(i, "same") for i in range(200)])
    found = exact.exact_duplicates(same).collect()
    assert {(r.keep_id, r.group_size) for r in found} == {(199, 200)} and [r.row.doc_id for r in found if r.kept] == [199]
    assert exact.exact_duplicates(docs.limit(0)).count() == 0 and exact.deduplicate(docs.limit(0)).columns == docs.columns


def test_exact_duplicates_shuffle_the_text_once(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    plan = exact._pieces(documents, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def runs_brute(w, exponent=4, least=6):
    found = {}
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = max(i + 1, j)
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(0, 80), rng.choice([1, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, (n - a) // 3 + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [rng.randrange(k) for _ in range(rng.randint(0, 4))]
    return w


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_square_catcher(exponent):
    rng = random.Random(exponent)
    for _ in range(150):
        w = some_words(rng)
        whole = runs.SquareCatcher(exponent)
        whole.append(np.array(w, dtype=np.int64))
        assert whole.runs() == runs_brute(w, exponent)
        parts, i = runs.SquareCatcher(exponent), 0
        while i < len(w):
            size = rng.choice([1, 1, 2, 9])
            parts.append(np.array(w[i : i + size]))
            i += size
            assert parts.runs() == runs_brute(w[:i], exponent)


def test_periodic_runs(docs, rows):
    found = runs.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    seen = set()
    for r in found:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")
        assert r.n_words == len(w) and r.row.rank == f"rank{r.row.doc_id}"
        if len(w) < 100 and r.row.text not in seen:
            seen.add(r.row.text)
            expected = runs_brute(w)
            dropped = {i for a, n, p in expected for i in range(a + p, a + n)}
            assert [tuple(x) for x in r.runs] == expected
            assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in dropped)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_query(spark, folder):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs_brute(w)
        dropped = {i for a, n, p in found for i in range(a + p, a + n)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[doc_id] == (
            len(found), *best, best[1] * 1000 // best[2] if found else None,
            digest("".join(f"{a},{n},{p}\n" for a, n, p in found)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)),
        )


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked_brute(docs, items, k):
    known = [(i, collections.Counter(terms(t))) for i, t in docs]
    known = [(i, c, sum(c.values())) for i, c in known if c]
    n_docs, words = len(known), sum(n for _, _, n in known)
    df = collections.Counter(t for _, c, _ in known for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in known:
            m = 75 + 25 * n * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("shard_bytes, query_terms, broadcast_terms", [(1 << 24, 1 << 16, 1 << 17), (300, 5, 0), (2000, 1 << 16, 0)])
def test_ranked_search(spark, shard_bytes, query_terms, broadcast_terms):
    rng = random.Random(7)
    some = lambda n: " ".join(f"W{min(int(rng.expovariate(0.1)), 60)}" for _ in range(n))
    rows = [(i, some(rng.choice([1, 5, 20, 60]))) for i in range(150)] + [(200 + i, "w1 w2-w3 Ünï") for i in range(60)]
    rows += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, None), (9, ""), (10, "?! .."), (11, LONG), (12, "z z q")]
    items = [(i, some(6)) for i in range(8)] + [(1, "w1 w1 w2 w40"), (1, "w1 w1 w2 w40"), (None, "ünï w3"), (20, None), (21, ""), (22, "unknown"), (23, "z z Q word1")]
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id LONG, text STRING, query STRING, rank STRING")
    index = ranked.build_index(table(spark, rows), shard_bytes)
    found = ranked.search(index, asked, 12, query_terms, broadcast_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert in_order(found.collect()) == in_order(ranked_brute(rows, items, 12))


def test_ranked_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    one = spark.createDataFrame([(1, "a copy")], "item_id LONG, text STRING")
    assert ranked.search(ranked.build_index(docs.limit(0)), one).count() == 0
    assert ranked.search(ranked.build_index(docs), none).count() == 0


def test_intervals_are_pruned(monkeypatch):
    """Fewer documents are scored than hold a term, with the same best ones."""
    rng = np.random.default_rng(3)
    tf = rng.integers(1, 4, 4000)
    tf[17] = 400
    doc = np.arange(4000, dtype=np.int32)
    lists = ranked.Postings(np.tile(doc, 2), np.tile(tf, 2).astype(np.int32), np.array([0, 4000]), np.array([4000, 8000]), np.full(4000, 100))
    opened = []
    largest = ranked.Postings.largest
    monkeypatch.setattr(ranked.Postings, "largest", lambda self, a, b: opened.append(len(a)) or largest(self, a, b))
    found, score = ranked.search_postings(lists, np.array([0, 1]), np.array([5, 7]), np.arange(4000), 1)
    assert found.tolist() == [17] and score.tolist() == [12 * (10**9 * 400 // (400_000 + 1200))] and sum(opened) < 10
