"""Random forests grown on counted rows, as MLlib models.

The learner sees features only by their bins (at most ``maxBins`` each), so rows of equal bins and label
are alike to it and are counted into one. A bootstrap of MLlib draws a count of mean 1 from a Poisson law for
each row and tree; the counts of n equal rows add up to a draw of mean n, so a tree draws one number per
counted row and the forest follows the same law as one grown on every row. What is passed over per tree and
level is bounded by the bins, not by the rows read.

A task grows whole trees, level by level, and holds one node and one draw per counted row. Everything else is
MLlib's: weighted Gini gain, features drawn per node, least rows per child, leaves of equal prediction merged.
Nodes are written in MLlib's own format and loaded from there. Counted rows are sorted and numbers are drawn in their
order, so a forest depends on the rows and the seed only, not on partitions or cores.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apronflow.operators.ranking import prefix_sum
from apronflow.sources.scratch import materialize, scratch_path

# counted rows handled at once, and those a task keeps instead of reading them again for every level
BLOCK_ROWS = 1 << 20
KEPT_ROWS = 4 << 20
# nodes whose sums a task holds at once
BLOCK_NODES = 4096
# trees are dealt in small portions, so that cores end together
PORTIONS = 4
# an impurity below it is none
EPSILON = 2.0**-52

NODE = """id: INT, prediction: DOUBLE, impurity: DOUBLE, impurityStats: ARRAY<DOUBLE>, rawCount: BIGINT, gain: DOUBLE, leftChild: INT,
rightChild: INT, split: STRUCT<featureIndex: INT, leftCategoriesOrThreshold: ARRAY<DOUBLE>, numCategories: INT>"""
TREE = "org.apache.spark.ml.classification.DecisionTreeClassificationModel"
FOREST = "org.apache.spark.ml.classification.RandomForestClassificationModel"
OF_FORESTS = ("numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate")


@dataclass(frozen=True)
class Growth:
    """What a task needs besides the counted rows."""

    edges: list[list[float]]
    weights: np.ndarray
    drawn: int
    depth: int
    min_rows: int
    min_share: float
    min_gain: float
    seed: int


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of the columns as a written table, with their number ``n``."""
    return materialize(df.groupBy(*dict.fromkeys(columns)).agg(F.count(F.lit(1)).alias("n")), "counted")


def fit(pipeline: Pipeline, rows: DataFrame, count: str = "n") -> PipelineModel:
    """The pipeline, a forest classifier behind feature stages, fitted to counted rows."""
    *stages, forest = pipeline.getStages()
    prepared = Pipeline(stages=stages).fit(rows)
    return PipelineModel([*prepared.stages, train_forest(prepared.transform(rows), forest, count)])


def _values(df: DataFrame, features: Column, weight: Column) -> DataFrame:
    """(feature, value, w): the weight of every value, as a decimal so that sums don't depend on their order."""
    each = df.select(F.posexplode(features).alias("feature", "value"), weight.cast("decimal(22,6)").alias("w"))
    return each.groupBy("feature", "value").agg(F.sum("w").alias("w"))


def split_points(df: DataFrame, features: Column, weight: Column, width: int, bins: int) -> list[list[float]]:
    """Thresholds per feature: the middles between neighbouring values, for a feature of more than ``bins`` values
    those nearest to equal shares of the weight."""
    values = materialize(_values(df, features, weight), "values")
    number = {r.feature: r.n for r in values.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    few, many = ([f for f in number if (number[f] <= bins) == small] for small in (True, False))
    edges: list[list[float]] = [[] for _ in range(width)]

    def middles(below: list[float], above: list[float]) -> list[float]:
        return [a + (b - a) / 2 for a, b in zip(below, above)]

    for f, found in values.filter(F.col("feature").isin(few)).groupBy("feature").agg(F.sort_array(F.collect_list("value"))).collect():
        edges[f] = middles(found, found[1:])
    if not many:
        return edges
    sums = prefix_sum(values.filter(F.col("feature").isin(many)), ["value"], "w", ["feature"], total="all")
    share = (F.col("before") + F.col("w")).cast("double") / F.col("all").cast("double") * bins
    nearest = sums.select("feature", "value", F.round(share).cast("int").alias("part"), F.abs(share - F.round(share)).alias("gap"))
    nearest = nearest.filter(F.col("part").between(1, bins - 1)).groupBy("feature", "part").agg(F.min_by("value", F.struct("gap", "value")).alias("value"))
    last = {r.feature: r.last for r in nearest.groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("last")).collect()}
    # the last value of a bin and the first of the next one
    ends = F.coalesce(*[F.when(F.col("feature") == f, _code(F.col("value"), x)) for f, x in last.items()])
    bounds = values.filter(F.col("feature").isin(list(last))).groupBy("feature", ends.alias("bin"))
    bounds = bounds.agg(F.min("value").alias("low"), F.max("value").alias("high")).orderBy("feature", "bin").collect()
    for f in last:
        own = [r for r in bounds if r.feature == f]
        edges[f] = middles([r.high for r in own], [r.low for r in own[1:]])
    return edges


def _code(value: Column, edges: list[float]) -> Column:
    """The number of thresholds below the value."""
    return F.size(F.filter(F.from_json(F.lit(json.dumps(edges)), "ARRAY<DOUBLE>"), lambda e: e < value))


class _Rows:
    """The counted rows of a written table in blocks (codes: rows x features, label, n), always in the same
    order; kept if there are at most ``KEPT_ROWS``."""

    def __init__(self, folder: str):
        self.folder, self.kept = folder, None

    def _batches(self) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".parquet")):
            with store.open_input_file(path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=BLOCK_ROWS, use_threads=False)

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in self._batches():
            if held and sum(b.num_rows for b in held) + batch.num_rows > BLOCK_ROWS:
                yield self._block(held)
                held = []
            held.append(batch)
        if held:
            yield self._block(held)

    @staticmethod
    def _block(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        *codes, label, n = (c.to_numpy() for c in pa.Table.from_batches(batches).columns)
        return np.column_stack(codes), label.astype(np.int64), n

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.kept is not None:
            yield from self.kept
            return
        found, rows = [], 0
        for block in self._blocks():
            rows += len(block[1])
            found = [*found, block] if rows <= KEPT_ROWS else []
            yield block
        if rows <= KEPT_ROWS:
            self.kept = found


def _gini(stats: np.ndarray, total: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, 1 - (stats**2).sum(axis=-1) / total**2, 0.0)


def best_splits(sums: np.ndarray, growth: Growth, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node of (nodes x drawn features x bins x classes) row counts: the largest gain (not above 0 without a split), the
    place among the drawn features and the last bin below."""
    below = sums.cumsum(axis=2)
    rows, all_rows = below[:, :, :-1].sum(axis=3), below[:, :, -1:].sum(axis=3)
    below = below * growth.weights
    total = below[:, :, -1:]
    below = below[:, :, :-1]
    size, whole = below.sum(axis=3), total.sum(axis=3)
    above = total - below
    rest = above.sum(axis=3)
    gain = _gini(total, whole) - size / whole * _gini(below, size) - rest / whole * _gini(above, rest)
    allowed = (rows >= growth.min_rows) & (all_rows - rows >= growth.min_rows) & (size >= least) & (rest >= least) & (gain >= growth.min_gain)
    gain = np.where(allowed, gain, -1.0).reshape(len(sums), -1)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(sums)), at], *np.divmod(at, sums.shape[2] - 1)


def grow(rows: _Rows, growth: Growth, tree: int) -> list[dict[str, np.ndarray]]:
    """One tree as the nodes of its levels: class counts, gain, and for inner nodes (feature >= 0) the feature and
    the last bin below; the children of a level's inner nodes follow one another in the next level."""
    rng = np.random.default_rng([growth.seed, tree])
    width, classes, bins = len(growth.edges), len(growth.weights), max(2, 1 + max(map(len, growth.edges)))
    # per block: places of the rows that are still in an open node, that node and their draws
    state = []
    for _, _, n in rows:
        draws = rng.poisson(n)
        at = np.flatnonzero(draws)
        state.append((at, np.zeros(len(at), np.int32), draws[at].astype(np.float64)))
    counts = np.zeros((1, classes))
    for (_, label, _), (at, _, draws) in zip(rows, state):
        counts[0] += np.bincount(label[at], draws, classes)
    least = growth.min_share * float((counts * growth.weights).sum())
    levels: list[dict[str, np.ndarray]] = []
    is_open = np.ones(1, bool)
    for depth in range(growth.depth + 1):
        size = len(counts)
        level = {"counts": counts, "feature": np.full(size, -1), "cut": np.zeros(size, np.int64), "gain": np.full(size, -1.0)}
        levels.append(level)
        weighted = counts * growth.weights
        is_open = is_open & (_gini(weighted, weighted.sum(axis=1)) >= EPSILON)
        if depth == growth.depth or not is_open.any():
            break
        # rows go by the number of their open node
        place = np.where(is_open, np.cumsum(is_open) - 1, -1).astype(np.int32)
        state = [(at[m], place[node[m]], draws[m]) for at, node, draws in state for m in (is_open[node],)]
        nodes = np.flatnonzero(is_open)
        chosen = rng.random((len(nodes), width)).argsort(axis=1)[:, : growth.drawn]
        sides = np.zeros((len(nodes), 2, classes))
        for a in range(0, len(nodes), BLOCK_NODES):
            b = min(len(nodes), a + BLOCK_NODES)
            sums = np.zeros((growth.drawn, (b - a) * bins * classes))
            for (codes, label, _), (at, node, draws) in zip(rows, state):
                if b - a < len(nodes):
                    inside = (node >= a) & (node < b)
                    at, node, draws = at[inside], node[inside], draws[inside]
                flat, first, cell = codes.ravel(), at * width, (node.astype(np.int64) - a) * (bins * classes) + label[at]
                for j in range(growth.drawn):
                    code = flat[first + chosen[node, j]]
                    sums[j] += np.bincount(cell + code.astype(np.int64) * classes, draws, sums.shape[1])
            sums = sums.reshape(growth.drawn, b - a, bins, classes).swapaxes(0, 1)
            gain, which, cut = best_splits(sums, growth, least)
            own = nodes[a:b]
            split = gain > 0
            level["gain"][own[split]], level["cut"][own[split]] = gain[split], cut[split]
            level["feature"][own[split]] = chosen[a:b][split, which[split]]
            best = sums[np.arange(b - a), which]
            lower = np.where((np.arange(bins) <= cut[:, None])[:, :, None], best, 0).sum(axis=1)
            sides[a:b] = np.stack([lower, best.sum(axis=1) - lower], axis=1)
        split = level["feature"][nodes] >= 0
        if not split.any():
            break
        counts = sides[split].reshape(-1, classes)
        is_open = np.ones(len(counts), bool)
        first_child = np.where(split, 2 * (np.cumsum(split) - 1), -1).astype(np.int32)
        feature, cut = level["feature"][nodes], level["cut"][nodes]
        moved = []
        for (codes, _, _), (at, node, draws) in zip(rows, state):
            m = split[node]
            at, node, draws = at[m], node[m], draws[m]
            above = codes.ravel()[at * width + feature[node]] > cut[node]
            moved.append((at, first_child[node] + above.astype(np.int32), draws))
        state = moved
    return levels


def merged(levels: list[dict[str, np.ndarray]], weights: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The levels without leaves whose sibling is a leaf of equal prediction: their parent becomes the leaf."""
    guess = [(x["counts"] * weights).argmax(axis=1) for x in levels]
    feature = [x["feature"].copy() for x in levels]
    for d in range(len(levels) - 2, -1, -1):
        inner = np.flatnonzero(levels[d]["feature"] >= 0)
        leaf, says = feature[d + 1].reshape(-1, 2) < 0, guess[d + 1].reshape(-1, 2)
        feature[d][inner[leaf.all(axis=1) & (says[:, 0] == says[:, 1])]] = -1
    out, kept = [], np.ones(1, bool)
    for d, x in enumerate(levels):
        out.append({**{c: v[kept] for c, v in x.items()}, "feature": feature[d][kept], "guess": guess[d][kept]})
        inner = x["feature"] >= 0
        kept = np.repeat((kept & (feature[d] >= 0))[inner], 2)
        if not kept.any():
            break
    return out


def _node_table(tree: int, levels: list[dict[str, np.ndarray]], growth: Growth) -> pa.RecordBatch:
    """The tree as rows of MLlib's node data, numbered level by level."""
    of = {c: np.concatenate([x[c] for x in levels]) for c in ("counts", "feature", "cut", "gain", "guess")}
    size, inner = len(of["feature"]), of["feature"] >= 0
    stats = of["counts"] * growth.weights
    left = np.full(size, -1)
    left[inner] = 1 + 2 * np.arange(inner.sum())
    at = np.flatnonzero(inner)
    threshold = np.array([growth.edges[f][c] for f, c in zip(of["feature"][at].tolist(), of["cut"][at].tolist())], np.float64)
    starts = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
    split = pa.StructArray.from_arrays(
        [pa.array(of["feature"], pa.int32()), pa.ListArray.from_arrays(pa.array(starts), pa.array(threshold)), pa.array(np.full(size, -1), pa.int32())],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    node = {
        "id": pa.array(np.arange(size), pa.int32()), "prediction": pa.array(of["guess"].astype(np.float64)),
        "impurity": pa.array(_gini(stats, stats.sum(axis=1))),
        "impurityStats": pa.ListArray.from_arrays(pa.array((np.arange(size + 1) * stats.shape[1]).astype(np.int32)), pa.array(stats.ravel())),
        "rawCount": pa.array(of["counts"].sum(axis=1).astype(np.int64)), "gain": pa.array(np.where(inner, of["gain"], -1.0)),
        "leftChild": pa.array(left, pa.int32()), "rightChild": pa.array(np.where(inner, left + 1, -1), pa.int32()), "split": split,
    }
    nodes = pa.StructArray.from_arrays(list(node.values()), list(node))
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, tree), pa.int32()), nodes], ["treeID", "nodeData"])


def _grower(folder: str, growth: Growth):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(folder)
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                yield _node_table(tree, merged(grow(rows, growth, tree), growth.weights), growth)

    return trees


def _metadata(kind: str, uid: str, forest: RandomForestClassifier, without: tuple[str, ...] = (), **more) -> str:
    """MLlib's description of a saved model."""
    named = lambda params: {p.name: v for p, v in params.items() if p.name not in without}
    return json.dumps({
        "class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__, "uid": uid,
        "paramMap": named(forest._paramMap), "defaultParamMap": named(forest._defaultParamMap), **more,
    })


def train_forest(df: DataFrame, forest: RandomForestClassifier, count: str = "n") -> RandomForestClassificationModel:
    """The forest of counted rows: ``df`` has the forest's feature vector, label and weight and ``count`` equal rows
    behind each. Weights must depend on the label only."""
    if (forest.getImpurity(), forest.getFeatureSubsetStrategy(), forest.getBootstrap(), forest.getSubsamplingRate()) != ("gini", "auto", True, 1.0):
        raise ValueError("forests of counted rows take Gini gain, the usual number of features and whole bootstraps")
    spark = df.sparkSession
    label, weight = F.col(forest.getLabelCol()), F.col(forest.getWeightCol()) if forest.isSet("weightCol") else F.lit(1.0)
    x = vector_to_array(forest.getFeaturesCol())
    classes = df.groupBy(label.cast("int").alias("y")).agg(F.min(weight).alias("low"), F.max(weight).alias("high"), F.max(F.size(x)).alias("width")).collect()
    if not classes:
        raise ValueError("a forest needs rows")
    if any(r.low != r.high for r in classes):
        raise ValueError("rows of a class must have one weight")
    width, trees = classes[0].width, forest.getNumTrees()
    weights = np.ones(max(r.y for r in classes) + 1)
    weights[[r.y for r in classes]] = [r.low for r in classes]
    edges = split_points(df, x, weight * F.col(count), width, forest.getMaxBins())
    codes = [_code(x[i], e).cast("short").alias(f"c{i}") for i, e in enumerate(edges)]
    names = [*(f"c{i}" for i in range(width)), "y"]
    folder, path = scratch_path(spark, "bins"), scratch_path(spark, "forest")
    bins = df.select(*codes, label.cast("short").alias("y"), F.col(count).alias("n")).groupBy(*names).agg(F.sum("n").alias("n"))
    bins.orderBy(*names).write.parquet(folder)
    growth = Growth(
        edges, weights, width if trees == 1 else math.ceil(math.sqrt(width)), forest.getMaxDepth(), forest.getMinInstancesPerNode(),
        forest.getMinWeightFractionPerNode(), forest.getMinInfoGain(), forest.getSeed() & (2**64 - 1),
    )
    tasks = min(trees, PORTIONS * spark.sparkContext.defaultParallelism)
    spark.range(0, trees, 1, tasks).mapInArrow(_grower(folder, growth), f"treeID INT, nodeData STRUCT<{NODE}>").write.parquet(f"{path}/data")
    of_tree = [(t, _metadata(TREE, f"dtc_{uuid4().hex[:12]}", forest, OF_FORESTS), 1.0) for t in range(trees)]
    spark.createDataFrame(of_tree, "_1 INT, _2 STRING, _3 DOUBLE").coalesce(1).write.parquet(f"{path}/treesMetadata")
    described = _metadata(FOREST, forest.uid, forest, numFeatures=width, numClasses=len(weights), numTrees=trees)
    spark.createDataFrame([(described,)], "value STRING").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
