"""Exact ranked lexical search with range-maximum tables over posting lists.

The documents are indexed once, as a written table of shards of about ``SHARD_BYTES`` of text: per shard
its terms, their document counts and posting lists, documents in order of length. A query starts with the
interval of all documents of a shard. Sparse tables over the impacts of each posting list answer where a
term's largest impact inside an interval lies; the sum of the terms' largest weighted impacts bounds
every document in it. The intervals of the largest bounds are opened first: each is split at the document of
its largest single impact, which is scored, and both remaining sides get bounds of their own. An interval
of at most ``LEAF`` documents is scored whole. Intervals bounded below the k-th best score are left.
All numbers are those of the whole table, so results of different shards merge exactly.

Queries meet the shards in blocks of about ``QUERY_TERMS`` terms by a join: broadcast where all
blocks together are proven to be small, dealt to (shard, block) otherwise.

Nulls and odd rows: a null or empty text has no term, isn't counted and isn't found; as a query it finds
nothing. Each row of the queries is one query, also where an item_id repeats or is null; repeated
documents are found each; equal scores go by doc_id (null last); other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apronflow.sources.scratch import materialize

K = 20
SHARD_BYTES = 16 << 20
QUERY_TERMS = 1 << 16
# query terms that may be broadcast: some 64 bytes each
BROADCAST_TERMS = 1 << 17
LEAF = 16
# intervals opened at once
OPENED = 64

# fixed values of the impact formula
SCALE, FLAT, LENGTH_SHARE = 1_000_000_000, 12, 25

ORACLE = r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
  lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
  totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
  weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM totals) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings GROUP BY term),
  asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
  placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 20"""


def _table() -> bytes:
    """Letters A-Z to lower case; all ASCII but letters and digits to blanks."""
    kept = [c if c > 127 or chr(c).isalnum() else 32 for c in range(256)]
    return bytes(c + 32 if 65 <= c <= 90 else c for c in kept)


TERM_BYTES = _table()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(TERM_BYTES).split() if text else []


INDEX = {
    "shard": pa.string(), "docs": pa.int64(), "words": pa.int64(), "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()),
    "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "doc": pa.binary(), "tf": pa.binary(),
}
INDEX_FIELDS = "shard string, docs bigint, words bigint, ids array<bigint>, lengths array<bigint>, terms array<string>, counts array<bigint>, doc binary, tf binary"


def _shard(ids: list[int | None], texts: list[list[int]], vocabulary: dict[bytes, int], name: str) -> pa.RecordBatch:
    """One index row; documents in order of length and id, postings by term, then document."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    keys = np.array([2**63 - 1 if i is None else i for i in ids], dtype=np.int64)
    order = np.lexsort((keys, lengths))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term = np.fromiter((t for text in texts for t in text), np.int64, int(lengths.sum()))
    pairs, tf = np.unique(term * len(ids) + np.repeat(rank, lengths), return_counts=True)
    counts = np.bincount(pairs // max(1, len(ids)), minlength=len(vocabulary))
    values = [
        name, len(ids), int(lengths.sum()), [ids[i] for i in order], lengths[order].tolist(),
        [w.decode("utf-8") for w in vocabulary], counts.tolist(),
        (pairs % max(1, len(ids))).astype(np.int32).tobytes(), tf.astype(np.int32).tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, INDEX.values())], list(INDEX))


def _indexer(shard_bytes: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        ids, texts, vocabulary, size = [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                ids.append(doc_id)
                texts.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
                size += len(text.as_buffer())
                if size >= shard_bytes:
                    yield _shard(ids, texts, vocabulary, uuid4().hex)
                    ids, texts, vocabulary, size = [], [], {}, 0
        if ids:
            yield _shard(ids, texts, vocabulary, uuid4().hex)

    return index


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of all rows of ``docs`` (doc_id, text), as a written table."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return materialize(rows.mapInArrow(_indexer(shard_bytes), INDEX_FIELDS), "ranked-index")


class Postings:
    """The posting lists of some terms, with sparse tables of where the largest impacts lie."""

    def __init__(self, doc: np.ndarray, tf: np.ndarray, starts: np.ndarray, stops: np.ndarray, m: np.ndarray) -> None:
        chosen, which = _ranges(starts, stops)
        tf = tf[chosen].astype(np.int64)
        self.docs = len(m)
        self.doc = doc[chosen].astype(np.int64)
        self.impact = SCALE * tf // (1000 * tf + FLAT * m[self.doc])
        self.at = np.concatenate([[0], np.cumsum(stops - starts)])
        self.key = which * self.docs + self.doc
        longest, n = int((stops - starts).max(initial=1)), len(chosen)
        sizes = [n - (1 << j) + 1 for j in range(longest.bit_length())]
        # level j at place i: where the largest impact among i .. i + 2**j - 1 lies
        self.level_at = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.empty(int(self.level_at[-1]), np.int32)
        self.flat[:n] = np.arange(n)
        for j in range(1, len(sizes)):
            below = self.flat[self.level_at[j - 1] : self.level_at[j]]
            left, right = below[: sizes[j]], below[1 << (j - 1) :]
            self.flat[self.level_at[j] : self.level_at[j + 1]] = np.where(self.impact[right] > self.impact[left], right, left)

    def largest(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Where the largest impacts of the ranges lie; an empty range gives any place."""
        size = np.maximum(stop - start, 1)
        level = np.frexp(size.astype(np.float64))[1] - 1
        base, last = self.level_at[level], len(self.impact) - 1
        begin = np.minimum(start, last)
        a = self.flat[base + np.minimum(begin, self.level_at[level + 1] - base - 1)]
        b = self.flat[base + np.clip(begin + size - (1 << level), 0, self.level_at[level + 1] - base - 1)]
        return np.where(self.impact[b] > self.impact[a], b, a)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    sizes = stops - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def search_postings(lists: Postings, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The k best (document, score) of a shard: scores above 0, equal ones by ``ids``."""
    best_doc, best_score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def bounded(lo, hi, start, stop):
        """Intervals with the place of each term's largest impact, the weighted impacts and their sum."""
        place = lists.largest(start, stop)
        value = np.where(stop > start, weights * lists.impact[place], 0)
        bound = value.sum(axis=1)
        return [x[bound >= least] for x in (lo, hi, start, stop, lists.doc[place[np.arange(len(lo)), value.argmax(axis=1)]], bound)]

    whole = np.array([0]), np.array([lists.docs]), lists.at[terms][None, :], lists.at[terms + 1][None, :]
    open_ = bounded(*whole)
    while len(open_[0]):
        bound = open_[5]
        if len(bound) > OPENED:
            top = np.argpartition(-bound, OPENED)
            chosen, rest = top[:OPENED], top[OPENED:]
        else:
            chosen, rest = np.arange(len(bound)), np.zeros(0, np.int64)
        lo, hi, start, stop, middle, _ = (x[chosen] for x in open_)
        small = hi - lo <= leaf
        # whole small intervals
        places, which = _ranges(start[small].ravel(), stop[small].ravel())
        found, at = np.unique(lists.doc[places], return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, at, weights[which % len(terms)] * lists.impact[places])
        # the others are split at their document of the largest impact
        lo, hi, start, stop, middle = (x[~small] for x in (lo, hi, start, stop, middle))
        cut = np.searchsorted(lists.key, terms * lists.docs + middle[:, None])
        holds = (cut < stop) & (lists.doc[np.minimum(cut, len(lists.doc) - 1)] == middle[:, None])
        score = np.where(holds, weights * lists.impact[np.minimum(cut, len(lists.doc) - 1)], 0).sum(axis=1)
        best_doc = np.concatenate([best_doc, found, middle])
        best_score = np.concatenate([best_score, sums, score])
        order = np.lexsort((ids[best_doc], -best_score))[:k]
        best_doc, best_score = best_doc[order], best_score[order]
        if len(order) == k:
            # an interval of an equal bound may hold a smaller id
            least = max(least, int(best_score[-1]))
        sides = bounded(
            np.concatenate([lo, middle + 1]), np.concatenate([middle, hi]),
            np.concatenate([start, cut + holds]), np.concatenate([cut, stop]),
        )
        kept = rest[bound[rest] >= least]
        open_ = [np.concatenate([x[kept], y]) for x, y in zip(open_, sides)]
    above = best_score > 0
    return best_doc[above], best_score[above]


def _searcher(k: int, docs: int, words: int):
    names = {"query": pa.int64(), "item_id": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(i)[row] for i, c in enumerate(batch.schema.names)}
                asked = cell["asked"].values
                query, item, weight = (asked.field(c) for c in ("query", "item_id", "weight"))
                place = pc.index_in(asked.field("term"), value_set=cell["terms"].values)
                known = place.is_valid().to_numpy(zero_copy_only=False)
                query, weight = query.to_numpy()[known], weight.to_numpy()[known]
                terms, term = np.unique(place.drop_null().to_numpy(), return_inverse=True)
                stops = np.cumsum(cell["counts"].values.to_numpy())
                starts = stops - cell["counts"].values.to_numpy()
                # whole numbers of any size: length times documents may pass 64 bits
                m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // words for n in cell["lengths"].as_py()], dtype=np.int64)
                doc, tf = (np.frombuffer(cell[c].as_buffer(), dtype=np.int32) for c in ("doc", "tf"))
                ids = [2**63 - 1 if i is None else i for i in cell["ids"].as_py()]
                ids, nulls = np.array(ids, dtype=np.int64), np.array([i is None for i in cell["ids"].as_py()])
                # null ids after all others, also after the largest number
                place_of = np.empty(len(ids), np.int64)
                place_of[np.lexsort((ids, nulls))] = np.arange(len(ids))
                out: list[list] = [[], [], [], []]
                if len(terms):
                    lists = Postings(doc, tf, starts[terms], stops[terms], m)
                    items = item.filter(pa.array(known)).to_pylist()
                    edges = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
                    for a, b in zip(edges, edges[1:]):
                        found, score = search_postings(lists, term[a:b], weight[a:b], place_of, k)
                        out[0] += [int(query[a])] * len(found)
                        out[1] += [items[a]] * len(found)
                        out[2] += [None if nulls[d] else int(ids[d]) for d in found]
                        out[3] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, names.values())], list(names))

    return search, "query bigint, item_id bigint, doc_id bigint, score bigint"


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, item_id, term, times) of each query's distinct terms."""
    from collections import Counter

    for batch in batches:
        counted = [Counter(terms_of(t)) for t in batch.column(2).to_pylist()]
        owner = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)),
             pa.array([w.decode("utf-8") for c in counted for w in c], pa.string()), pa.array([n for c in counted for n in c.values()], pa.int64())],
            ["query", "item_id", "term", "times"],
        )


def search(index: DataFrame, queries: DataFrame, k: int = K, query_terms: int = QUERY_TERMS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of ``index`` for each row of ``queries`` (item_id, text)."""
    totals = index.agg(F.sum("docs"), F.sum("words")).first()
    docs, words = totals[0] or 0, totals[1] or 1
    numbered = queries.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long"), F.col("text"))
    asked = materialize(numbered.mapInArrow(_query_terms, "query bigint, item_id bigint, term string, times bigint"), "asked")
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    found = asked.select("term").distinct().join(counts, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * docs + 2)) / (2 * F.col("df") + 1))) * F.col("times")
    weighed = materialize(asked.join(found, "term").select("query", "item_id", "term", weight.alias("weight")), "weighed")
    n = weighed.count()
    parts = max(1, -(-n // query_terms))
    entries = F.array_sort(F.collect_list(F.struct("query", "item_id", "term", "weight")))
    blocks = weighed.groupBy(F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("block")).agg(entries.alias("asked"))
    blocks = materialize(blocks, "query-blocks")
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if n <= broadcast_terms:
        pairs = shards.join(F.broadcast(blocks), "block")
    else:
        names = index.select("shard")
        pairs = shards.join(blocks.join(names.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "block"), ["shard", "block"])
    searcher, fields = _searcher(k, docs, words)
    best = pairs.select("ids", "lengths", "terms", "counts", "doc", "tf", "asked").mapInArrow(searcher, fields)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return placed.select("item_id", "rank", "doc_id", "score")
