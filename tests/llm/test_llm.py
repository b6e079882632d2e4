"""The training-text operators against plain Python on small tables with odd rows."""

import base64
import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from apronflow.llm import bpe, classifier, licenses, lm, mixing, queries, rules, search, simhash, urls, warc
from apronflow.llm.components import components
from apronflow.sources.scratch import scratch_path

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, kept STRING, score STRING, ids STRING"
PROSE = "The quick brown fox jumps over the lazy dog while seven grey geese watch from a far hill and say nothing at all. "
LONG = "".join(f"word{i % 977} of{i % 31} " for i in range(30_000))


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "  \n\t", "a", "a b", PROSE, PROSE, PROSE.upper(), PROSE + "end", LONG, LONG, "x\n\nx\nx\ny", "Ünï cödé\x0bπ $ # <b>",
             "MIT License", "the gnu  GENERAL public-license, cc by; CC BY mit licence apache licens", "the the the the " * 30]
    found = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "no", "no", "no") for i, t in enumerate(texts)]
    return found + [found[5], (None, PROSE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0), (15, 0, 0), (8, 1, 0), (None, 1, 0), (9, None, 0), (6, 1, 0)], "doc_id LONG, quality INT, toxic INT")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash_of(text):
    w = words(ascii_lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    found = simhash.near_duplicate_groups(docs).collect()
    prints = [simhash_of(r[1]) for r in rows]
    groups = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = groups[i], groups[j]
                groups = [new if g == old else g for g in groups]
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    expected = [(r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups)]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({x for x in least.values() if x is not None}) and ids.count(None) == 2
    assert simhash.near_duplicate_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_of_each_group_where_ids_repeat(spark):
    other = "a wholly different text about ships that sail past the harbour light at dawn with all hands on deck"
    third = "numbers and letters make up this one and it resembles neither of the two texts that stand before it here"
    table = spark.createDataFrame([(1, PROSE), (1, other), (0, other.upper()), (2, third), (2, PROSE), (2, third), (3, third)], "doc_id LONG, text STRING")
    assert len({simhash_of(t) for t in (PROSE, other, third)}) == 3
    assert sorted(map(tuple, simhash.keep_one(table).collect())) == sorted([(0, other.upper()), (1, PROSE), (2, third)])


def test_print_links_keep_every_link(spark):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)] + [0, -1, 0x5555555555555555]
    prints = set(seeds)
    for s in seeds:  # crowds around each, one to four bits off
        for _ in range(40):
            x = np.int64(s)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= np.int64(1) << np.int64(b)
            prints.add(int(x))
    prints = sorted(prints)
    links = simhash.print_links(spark.createDataFrame([(p,) for p in prints], "print LONG"))
    got = {r.node: r.label for r in components(links).collect()}
    unsigned = np.array(prints, dtype=np.int64).view(np.uint64)
    label = dict(zip(prints, prints))
    changed = True
    near = [unsigned[np.bitwise_count(unsigned ^ p) <= 2].view(np.int64).tolist() for p in unsigned]
    while changed:
        changed = False
        for p, others in zip(prints, near):
            least = min(label[o] for o in others)
            changed |= least < label[p]
            label[p] = least
    assert {p: got.get(p, p) for p in prints} == label
    assert all((np.int64(r.a) ^ np.int64(r.b)).astype(np.uint64).item().bit_count() <= 2 for r in links.collect())


def test_components_of_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 5000: 0, **{i: 1000 for i in range(1000, 1400)}}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_search(docs, rows, empty):
    corpus = [(r[0], collections.Counter(words(ascii_lower(r[1])))) for r in rows]
    n, mean = len(corpus), sum(sum(c.values()) for _, c in corpus) / len(corpus)
    df = collections.Counter(w for _, c in corpus for w in c)
    got = collections.defaultdict(list)
    for r in search.top_k(docs, docs.filter("doc_id in (5, 8, 9, 13, 0, 1)"), k=4, shard_docs=5, query_terms=200).collect():
        got[r.query_id].append(r)
    assert not {0, 1} & got.keys()
    for q, times in ((5, 2), (8, 1), (9, 1), (13, 1)):
        scores = []
        for i, c in corpus:
            length = sum(c.values())
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w, m in corpus[q][1].items() if w in c)
            if s:
                scores.append((-round(s, 6), i is not None, i or 0))
        expected = [(i if known else None, -s) for s, known, i in sorted(scores)[:4]]
        assert len(got[q]) == len(expected) * times
        for copy in range(times):
            found = sorted(got[q], key=lambda r: r["rank"])[copy::times]
            assert [r.doc_id for r in found] == [i for i, _ in expected]
            assert [r.score for r in found] == pytest.approx([s for _, s in expected], abs=2e-6)
    assert search.top_k(empty, empty).count() == 0


def test_classifier(spark, docs, empty, labels, folder):
    got = queries.op3_quality_classifier(spark, folder.replace("0.001", "0.01")).toPandas()
    known = spark.read.parquet(folder.replace("0.001", "0.01") + "/labels.parquet").toPandas()
    both = got.merge(known, on="doc_id")
    held = both[both.held_out]
    assert set(held.doc_id) == {i for i in both.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held[held.quality == 1].predicted == 1).mean() > 0.95
    assert held[held.quality == 1].score.mean() > held[held.quality == 0].score.mean() + 0.3
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    net = classifier.fit(docs, labels, per_class=5)
    out = classifier.classify(docs, net)
    rows = out.collect()
    assert all(0 <= r.score <= 1 for r in rows) and out.columns.count("score") == 1
    assert len({r.score for r in rows if not r.text}) == 1
    assert classifier.classify(empty, classifier.fit(empty, labels)).count() == 0
    assert classifier.fit(docs, labels.filter("quality = 1")).score(["x"])[0] > 0.99


def test_training_reads_whole_texts(spark, monkeypatch):
    marked = PROSE * 60 + "@@@@@@ " + PROSE * 60  # the mark in one chunk of the middle
    table = spark.createDataFrame([(2, marked), (4, LONG), (6, "short"), (7, None)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(2, 0), (4, 1), (6, 1), (7, 0)], "doc_id LONG, quality INT")
    seen = []
    monkeypatch.setattr(classifier, "train", lambda samples, share: seen.extend(samples))
    classifier.fit(table, labels, per_class=5)
    monkeypatch.undo()
    step = classifier.CHUNK - classifier.WIDTH + 1
    expected = {i: (t or "").encode() for i, t in ((2, marked), (4, LONG), (6, "short"), (7, None)) if zlib.crc32(str(i).encode()) % 5}
    assert {2, 4} <= expected.keys()
    assert sorted(b"".join(c[:step] for c in chunks) for chunks, _ in seen) == sorted(expected.values())
    nets = []
    for piece in (512, 5):
        monkeypatch.setattr(classifier, "PIECE", piece)
        nets.append(classifier.train(seen, 0.5, epochs=2))
    assert (nets[0].filters == nets[1].filters).all() and (nets[0].weights == nets[1].weights).all()


def test_scores_cover_whole_texts():
    rng = np.random.default_rng(1)
    net = classifier.constant(0.5)
    net.filters[:, :256] = rng.normal(size=(classifier.WIDTH, 256, classifier.FILTERS))
    net.weights = rng.normal(size=2 * classifier.FILTERS) / 10
    texts = ["", "a", "abcde", PROSE, LONG[:300_001], None, PROSE * 50]
    step = classifier.CHUNK - classifier.WIDTH + 1
    for block in (1 << 18, 1000):
        scores = net.score(texts, block)
        for text, score in zip(texts, scores):
            data = list((text or "").encode()) or [256]
            count = len(data)
            data = np.array(data + [256] * (classifier.WIDTH - 1))
            response = net.responses(data)
            tops = np.maximum([response[k : min(k + step, count)].max(axis=0) for k in range(0, count, step)], 0)
            assert score == pytest.approx(net.probability(tops.mean(axis=0)[None], tops.max(axis=0)[None])[0], abs=1e-5)


def test_rule_counts(docs, rows, empty, labels):
    def counts(text):
        w, lines, seen, repeated = words(text), [x for x in (text or "").split("\n") if words(x)], set(), 0
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        for line in lines:
            repeated += line in seen
            seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)

    out = rules.quality_rules(docs, labels)
    got = out.collect()
    assert len(got) == len(rows) and out.columns.count("kept") == 1
    for r in got:
        expected = counts(r.text)
        assert tuple(r[c] for c in rules.COUNTS) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert r.kept == (not r.base_failed and r.llr >= rules.THRESHOLD)
    assert out.filter("kept").count() == sum(r.kept for r in got)
    assert rules.quality_rules(empty, labels).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lm(docs, rows, empty):
    tokens = [(r[0], words(ascii_lower(r[1])) + [""]) for r in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens]
    counts = collections.Counter(t for (_, ts), h in zip(tokens, held) if not h for t in ts)
    n, v = sum(counts.values()), len(counts)
    got = lm.score(docs, bits=1 << 20).collect()
    expected = [(i, h, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 5)) for (i, ts), h in zip(tokens, held)]
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert all(r.score < 0 for r in got)
    assert lm.score(empty, bits=1 << 20).count() == 0


def test_lm_model_holds_every_pair(spark, docs, rows):
    """Brute-force scores; and a filter that grows with its entries, pairs seen once included."""
    tokens = [(r[0], words(ascii_lower(r[1])) + [""]) for r in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens]
    single, pairs = collections.Counter(), collections.Counter()
    for (_, ts), out in zip(tokens, held):
        if not out:
            single.update(ts)
            pairs.update(zip(["", *ts], ts))
    divisor = sum(single.values()) + 0.5 * (len(single) + 1)
    about = lambda n: 0 if n == 0 else 1 if n == 1 else 1.5 * 2 ** (n.bit_length() - 1) - 0.5
    expected = collections.defaultdict(list)
    for i, ts in tokens:
        total = 0
        for a, b in zip(["", *ts], ts):
            both = about(pairs[a, b])
            total += math.log10((both + 4 * (about(single[b]) + 0.5) / divisor) / (max(about(single[a]), both) + 4))
        expected[i].append(total)
    got = collections.defaultdict(list)
    for r in lm.score(docs, bits=1 << 26).collect():
        got[r.doc_id].append(r.score)
    assert got.keys() == expected.keys()
    for i in got:
        assert sorted(got[i]) == pytest.approx(sorted(expected[i]), rel=1e-6)
    assert list(pairs.values()).count(1) > 20
    once = spark.range(2000).select(F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(f"-{j}"))) for j in range(20)]).alias("text"))
    for part in (500, 2000):
        found = lm.build_segments(once.limit(part), 8, bits=64).collect()
        assert sum(r.entries for r in found) >= 40 * part
        assert all(8 * len(r.octets) >= r.entries * lm.PROBES / math.log(2) for r in found)


def test_bloom_filter_levels():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, 20_000) & ~1)
    n = 2 ** rng.integers(0, 8, len(keys))
    rows = pa.table({"segment": [0], "keys": [keys.astype("<i8").tobytes()], "n": [n.astype("<u4").tobytes()]})
    built = lm._segment_builder(64, lm.PROBES)(rows).to_pylist()[0]
    octets = np.frombuffer(built["octets"], np.uint8)
    assert 8 * len(octets) >= built["entries"] * lm.PROBES / math.log(2) and built["v"] == len(keys) and built["n"] == n.sum()
    read = lm.read_levels(keys.view(np.uint64), octets, 1, 8 * len(octets), 1, lm.PROBES)
    true = np.log2(n).astype(int) + 1
    assert (read >= true).all() and (read == true).mean() > 0.9
    others = lm.read_levels((keys + 2).view(np.uint64), octets, 1, 8 * len(octets), 1, lm.PROBES)
    assert (others == 0).mean() > 0.9


def test_warc(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"<p>{i % 7}</p>" * 50) for i in range(60)] + [(60, None, None), (61, "u", ""), (62, "ü\nx", "é" * 100_000), (None, "n", "<p>1</p>" * 50), (62, "ü\nx", "é" * 100_000)]
    table = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING").withColumn("digest", F.lit("clash")).repartition(5)
    files = {}
    for name in ("a", "b"):
        folder = scratch_path(spark, "warc-test")
        warc.write_archives(table.repartition(3 if name == "a" else 7), folder, roll_bytes=300)
        got = warc.read_archives(spark, folder).collect()
        files[name] = sorted(map(tuple, spark.read.parquet(folder + "/manifest").collect()))
    assert files["a"] == files["b"] and len(files["a"]) > 5
    best = {}
    for i, _, html in pages:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    expected, used = [], set()
    for i, _, html in pages:
        body = (html or "").encode()
        first = i == best[html or ""] and i not in used
        used.add(i)
        expected.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, expected))
    one = gzip.open(folder.removeprefix("file://") + "/" + files["b"][0][0]).read()
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: re")
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(table.limit(0), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_licenses(spark, docs, rows, empty):
    out = licenses.scan(docs)
    got = out.collect()
    assert len(got) == len(rows) and out.columns.count("score") == 1
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(r.text))
        places = [(i, label) for phrase, label, _ in licenses.NOTICES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    cases = {
        "see the mit licens here": ("mit", "mit licens"),
        "x gnu genral publick license y": ("gpl", "gnu genral publick license"),
        "the apashe licence.": ("apache", "apashe licence"),
        "gnu generous license": ("", None),
        "ccby": ("", None),
    }
    table = spark.createDataFrame([(t,) for t in cases], "text STRING")
    for r in licenses.scan(table).collect():
        label, found = cases[r.text]
        assert r.labels == label and r.n_base == 0 and (not found or found in [s.found for s in r.spans])
        assert (0.5 < r.score < 1) if label else r.score == 0
        for s in r.spans:
            assert " ".join(re.findall("[a-z]+", r.text)[s.first_word : s.end_word]) == s.found
    assert licenses.scan(empty).count() == 0


def test_urls(spark):
    cases = {
        "http://WWW.Example.ORG/es/5?x": ("www.example.org", "/es/5", "example.org/es/", "block"),
        "https://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://a.org/": ("a.org", "/", "org/", "allow"),
        "x://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/de/1": ("b.com", "/de/1", "com/de/", "block"),
        "x://notorg/": ("notorg", "/", None, None),
        "x://b.net?q=/fr/": ("b.net", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "x://" + "é" * 20_000 + "/ABC": ("é" * 20_000, "/ABC", None, None),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] + [(0, "http://a.org/", "x")]
    table = spark.createDataFrame(rows, "page_id LONG, url STRING, host STRING")
    out = urls.url_filter(table)
    for r in out.collect():
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.url_filter(table.limit(0)).count() == 0
    assert {r.verdict for r in urls.url_filter(table.filter("url = 'no scheme'")).collect()} == {"allow"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary(open(path, "rb").read())
    return path, vocabulary, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_bpe(spark, docs, rows, empty, encoding):
    path, _, reference = encoding
    more = ["a" * 3000, " " * 500 + "x", "日本語のテキスト🙂🙂", "1234567 it's\r\n\r\n\tx", "é" * 400, "<|endoftext|>"]
    table = docs.select("doc_id", "text", "ids").union(spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(more)], "doc_id LONG, text STRING, ids STRING"))
    for r in bpe.decode(bpe.encode(table, path, public_tokenizers.PATTERN), path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0
    apart = bpe.decode(bpe.encode(table, path, public_tokenizers.PATTERN), path).drop("text")
    assert sorted(bpe.round_trip(table, path, public_tokenizers.PATTERN).collect(), key=str) == sorted(apart.collect(), key=str)


def test_bpe_appends_and_edits(encoding):
    _, vocabulary, _ = encoding
    rng = np.random.default_rng(2)
    data = bytes(rng.choice(list(b"aehtn "), 400).tolist())
    table = bpe.Prefixes(vocabulary)
    for at in range(0, 400, 57):
        table.append(data[at : at + 57])
        assert table.ids() == vocabulary.merge(data[: at + 57])
    for _ in range(20):
        a = int(rng.integers(0, len(table.data)))
        b = min(len(table.data), a + int(rng.integers(0, 9)))
        new = bytes(rng.choice(list(b"aehtn "), int(rng.integers(0, 9))).tolist())
        before, size = table.data, len(table.data)
        redone = table.replace(a, b, new)
        assert table.data == before[:a] + new + before[b:] and table.ids() == vocabulary.merge(table.data)
        assert redone <= size
    assert table.replace(5, 6, b"q") < 200  # the rest of the table is kept


def test_mixing(spark, docs, rows, empty):
    drawn = mixing.with_copies(docs, mixing.source_rates(docs, {"s0": 1, "s1": 2, None: 1}, size=40), seed=3).collect()
    assert len(drawn) == len(rows)
    for r in drawn:
        pieces = max(1, math.ceil(r.rate / 32))
        copies = 0
        for j in range(1, pieces + 1):
            name = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
            u = int(hashlib.md5(f"3-{j}-{name}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-r.rate / pieces)
            k = 0
            while c <= u:
                k += 1
                p *= r.rate / pieces / k
                c += p
            copies += k
        assert r.copies == copies and (r.source != "s2" or r.copies == 0)
    total = sum(r[4] or 0 for r in rows)
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    mixed = mixing.poisson_mix(table, {"hot": 1, "s0": 1, "s1": 1, "s2": 1, "s3": 1}, size=2.0)
    shares = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert total and all(abs(n - 8000) < 500 for n in shares.values()) and len(shares) == 5
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.poisson_mix(table.repartition(5), {"hot": 1, "s0": 1, "s1": 1, "s2": 1, "s3": 1}, size=2.0).collect()))
    out = mixing.poisson_mix(docs.withColumn("rate", F.lit(1)))
    assert out.columns.count("rate") == 1
    assert mixing.poisson_mix(empty).count() == 0


def test_pipeline(spark, docs, empty, folder):
    import corpus_pipeline

    table = spark.read.parquet(folder + "/documents.parquet")
    odd = docs.select(table.columns)
    for given in (table.union(odd), empty.select(table.columns)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns
                kept = out.collect()
                if name != "mixing":
                    before = collections.Counter(r.doc_id for r in now.collect())
                    assert not collections.Counter(r.doc_id for r in kept) - before
                out = spark.createDataFrame(kept, table.schema)
            now = out
        assert set(now.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    assert now.count() == 0
