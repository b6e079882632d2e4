"""Exact path-dependent Shapley values of tree ensembles.

A model is first laid out as a node table. For a row and a leaf, every feature on the leaf's path either
lets the row through (its value lies in the path's interval) or not; the share of training weight that
follows the path stands for a feature left out. The leaf's part of a feature's Shapley value is an
integral of a polynomial in these two kinds of numbers, which Gauss-Legendre nodes give exactly. It depends
on the row only through which features let it through, so each leaf needs one small table for a whole
batch of rows. Contributions and base add up to the ensemble's output.

``explain`` works on the distinct feature vectors of a table, whose results the rows read by a join.

Nodes are collected after their size is checked, and sent in parts of at most ``PART_BYTES`` (laid out for
use); parts are added up in passes over the rows, nothing is shuffled by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apronflow.models.scoring import per_vector, top_factors
from apronflow.sources.scratch import scratch_path

PART_BYTES = 64 << 20
# leaves whose tables are made at once, and the bytes these take if they are several
LEAVES = 256
TABLE_BYTES = 32 << 20

# value: what a leaf adds to the output, one number per class; rows with x <= threshold go below
NODES = "tree INT, node INT, feature INT, threshold DOUBLE, below INT, above INT, cover DOUBLE, value ARRAY<DOUBLE>"


def forest_nodes(model) -> DataFrame:
    """The node table of an MLlib tree ensemble: forests add class shares or means, boosted trees
    their weighted outputs (the margin). Splits must be numeric."""
    name, spark = type(model).__name__, SparkSession.active()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    if saved.filter("split.numCategories > 0").limit(1).count():
        raise ValueError("splits by category have no threshold; index the features as numbers")
    share = F.element_at(F.lit([float(w) for w in model.treeWeights]), F.col("treeID") + 1)
    stats = F.col("impurityStats")
    if name == "RandomForestClassificationModel":
        cover = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
        value = F.transform(stats, lambda s: s / cover / len(model.treeWeights))
    elif name == "RandomForestRegressionModel":
        cover, value = stats[0], F.array(F.col("prediction") / len(model.treeWeights))
    else:
        cover, value = stats[0], F.array(F.col("prediction") * share)
    return saved.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("below"),
        F.col("rightChild").alias("above"),
        cover.alias("cover"),
        value.alias("value"),
    )


def _parts(nodes: DataFrame, width: int, part_bytes: int) -> list[DataFrame]:
    """The nodes in runs of whole trees that fit into ``part_bytes``."""
    sizes = nodes.groupBy("tree").agg((F.count(F.lit(1)) * (24 * width + 64)).alias("bytes")).orderBy("tree").collect()
    parts: list[list] = []
    room = 0
    for tree, size in sizes:
        if size > part_bytes:
            raise ValueError(f"tree {tree} takes {size} bytes, {part_bytes} are allowed at once")
        if not parts or room + size > part_bytes:
            parts.append([tree, tree])
            room = 0
        parts[-1][1], room = tree, room + size
    return [nodes.filter(F.col("tree").between(a, b)) for a, b in parts]


def leaf_paths(nodes: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Per leaf and feature: the interval (low, high] of its path and the share of training weight that
    follows the path at the feature's splits; and the leaf's values."""
    n = len(nodes["tree"])
    place = {key: i for i, key in enumerate(zip(nodes["tree"].tolist(), nodes["node"].tolist()))}
    low, high, share = np.full((n, width), -np.inf), np.full((n, width), np.inf), np.ones((n, width))
    used = np.zeros((n, width), bool)
    inner = nodes["below"] >= 0
    child = {
        side: np.array([place[t, c] if c >= 0 else -1 for t, c in zip(nodes["tree"].tolist(), nodes[side].tolist())], dtype=np.int64)
        for side in ("below", "above")
    }
    is_child = np.zeros(n, bool)
    for side in child.values():
        is_child[side[inner]] = True
    level = np.flatnonzero(~is_child)
    while len(level):
        level = level[inner[level]]
        feature = nodes["feature"][level]
        following = []
        for side, bound in (("below", high), ("above", low)):
            at = child[side][level]
            for table in (low, high, share, used):
                table[at] = table[level]
            rest = nodes["threshold"][level]
            bound[at, feature] = np.minimum(bound[at, feature], rest) if side == "below" else np.maximum(bound[at, feature], rest)
            share[at, feature] *= nodes["cover"][at] / nodes["cover"][level]
            used[at, feature] = True
            following.append(at)
        level = np.concatenate(following)
    leaf = ~inner
    return {"low": low[leaf], "high": high[leaf], "share": share[leaf], "used": used[leaf], "value": nodes["value"][leaf]}


@cache
def _masks(d: int) -> np.ndarray:
    """Which of d features each mask names."""
    return ((np.arange(2**d) >> np.arange(d)[:, None]) & 1).astype(bool)


@cache
def _gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n Gauss-Legendre nodes and weights over 0 to 1."""
    at, weight = np.polynomial.legendre.leggauss(n)
    return (at + 1) / 2, weight / 2


def _weights(share: np.ndarray, through: np.ndarray | None = None) -> np.ndarray:
    """Shapley values (features x rows) of the game "all known features let the row through, shares for
    those left out": for each column of ``through``, by default for every mask."""
    d = len(share)
    at, weight = _gauss((d + 1) // 2)
    lets, stops = share[:, None] * (1 - at) + at, share[:, None] * (1 - at)
    if through is None:
        product = np.ones((1, len(at)))
        for yes, no in zip(lets, stops):
            product = np.concatenate([product * no, product * yes])
        through = _masks(d)
    else:
        product = np.ones((through.shape[1], len(at)))
        for row, yes, no in zip(through, lets, stops):
            product *= np.where(row[:, None], yes, no)
    passed = (1 - share)[:, None] * ((weight / lets) @ product.T)
    failed = -share[:, None] * ((weight / stops) @ product.T)
    return np.where(through, passed, failed)


def _tables(share: np.ndarray) -> np.ndarray:
    """``_weights`` of many leaves (leaves x features) for every mask: leaves x features x masks."""
    leaves, d = share.shape
    at, weight = _gauss((d + 1) // 2)
    lets, stops = share[:, :, None] * (1 - at) + at, share[:, :, None] * (1 - at)
    product = np.ones((leaves, 1, len(at)))
    for i in range(d):
        product = np.concatenate([product * stops[:, i, None], product * lets[:, i, None]], axis=1)
    product = product.swapaxes(1, 2)
    passed = (1 - share)[:, :, None] * ((weight / lets) @ product)
    failed = -share[:, :, None] * ((weight / stops) @ product)
    return np.where(_masks(d), passed, failed)


def _groups(codes: np.ndarray) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Features whose values occur in few combinations: (features, features x combinations, combination of each row)."""
    groups: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    for f, column in enumerate(codes):
        if groups:
            members, combinations, row = groups[-1]
            both, first, back = np.unique(row * (column.max() + 1) + column, return_index=True, return_inverse=True)
            if len(both) <= max(len(column) // 8, 1):
                groups[-1] = [*members, f], codes[[*members, f]][:, first], back
                continue
        values, back = np.unique(column, return_inverse=True)
        groups.append(([f], values[None], back))
    return groups


def contributions(x: np.ndarray, pick: np.ndarray, paths: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x features, base per row) for the value column ``pick`` of each row.

    A leaf has one table entry per class and mask of the features that let a row through. Masks are put together from
    those of groups of features, so a leaf costs a few look-ups per row, not one pass per feature.
    """
    x = np.where(np.isnan(x), np.inf, x).T
    width, rows = x.shape
    low, high, share, used, value = (paths[c] for c in ("low", "high", "share", "used", "value"))
    classes = value.shape[1]
    pick = pick if classes > 1 else np.zeros(rows, np.int64)
    out = np.zeros((rows, width))
    if not rows or not len(value):
        return out, np.zeros(rows)
    base = (value * share.prod(axis=1)[:, None]).cumsum(axis=0)[-1][pick]
    known = [np.unique(column, return_inverse=True) for column in x]
    # a value lets the row through if its place is from first to before last
    first = np.column_stack([np.where(low[:, f] == -np.inf, 0, np.searchsorted(v, low[:, f], "right")) for f, (v, _) in enumerate(known)])
    last = np.column_stack([np.where(high[:, f] == np.inf, len(v), np.searchsorted(v, high[:, f], "right")) for f, (v, _) in enumerate(known)])
    codes = np.stack([back for _, back in known])
    groups, sizes, bit = _groups(codes), used.sum(axis=1), used.cumsum(axis=1) - 1
    mask, found = np.empty(rows, np.intp), np.empty((rows, width))
    # leaves are added up in their order; larger tables than there are rows are not made
    made = [d for d in range(1, width + 1) if 2**d <= rows]
    class_at = {d: pick.astype(np.intp) << d for d in made}
    step = max(1, min(LEAVES, TABLE_BYTES // (width * 8 * (classes << max(made, default=0)))))
    for start in range(0, len(value), step):
        chunk = slice(start, start + step)
        entries: list[np.ndarray | None] = [None] * len(sizes[chunk])
        for d in made:
            part = start + np.flatnonzero(sizes[chunk] == d)
            if len(part):
                on = np.nonzero(used[part])[1].reshape(-1, d)
                filled = np.zeros((len(part), 2**d, width))
                filled[np.arange(len(part))[:, None], :, on] = _tables(share[part[:, None], on])
                filled = (filled[:, None] * value[part][:, :, None, None]).reshape(len(part), classes << d, width)
                for leaf, table in zip(part.tolist(), filled):
                    entries[leaf - start] = table
        masks = []
        for members, combinations, _ in groups:
            of = np.zeros((len(entries), combinations.shape[1]), np.intp)
            for f, at in zip(members, combinations):
                place = np.arange(len(known[f][0]))
                lets = (place >= first[chunk, f, None]) & (place < last[chunk, f, None]) & used[chunk, f, None]
                of += (lets.astype(np.intp) << np.maximum(bit[chunk, f, None], 0))[:, at]
            masks.append(of)
        for i, table in enumerate(entries):
            leaf = start + i
            if table is not None:
                mask[:] = class_at[int(sizes[leaf])]
                for of, (_, _, row) in zip(masks, groups):
                    mask += of[i].take(row)
                table.take(mask, axis=0, out=found, mode="clip")
                out += found
            elif sizes[leaf]:
                on = np.flatnonzero(used[leaf])
                through = (codes[on] >= first[leaf, on, None]) & (codes[on] < last[leaf, on, None])
                out[:, on] += (_weights(share[leaf, on], through) * value[leaf][pick]).T
    return out, base


def _adder(sent, width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = leaf_paths(sent.value, width)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {c: i for i, c in enumerate(batch.schema.names)}
            x = batch.column(at["x"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            pick = batch.column(at["pick"]).to_numpy()
            # rows of equal features are explained once
            rows, back = np.unique(np.column_stack([x, pick]), axis=0, return_inverse=True)
            values, base = contributions(rows[:, :width], rows[:, width].astype(np.int64), paths)
            values, base = values[back.ravel()], base[back.ravel()]
            sums = batch.column(at["sums"]).flatten().to_numpy().reshape(-1, width) + values
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            columns = list(batch.columns)
            columns[at["sums"]] = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))
            columns[at["base"]] = pa.array(batch.column(at["base"]).to_numpy() + base)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return add


def shapley_values(rows: DataFrame, nodes: DataFrame, width: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """``rows`` (row, x array of ``width`` numbers, pick: which leaf value is explained) with sums (one
    contribution per feature) and base. A null or NaN feature goes above every threshold."""
    spark = rows.sparkSession
    filled = F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))
    zeros = F.array_repeat(F.lit(0.0), width)
    out = rows.select("row", filled.alias("x"), "pick", zeros.alias("sums"), F.lit(0.0).alias("base"))
    for part in _parts(nodes, width, part_bytes):
        table = part.toArrow()
        arrays = {c: table[c].to_numpy() for c in ("tree", "node", "feature", "threshold", "below", "above", "cover")}
        arrays["value"] = np.array(table["value"].to_pylist(), dtype=np.float64)
        out = out.mapInArrow(_adder(spark.sparkContext.broadcast(arrays), width), out.schema)
    return out


def explain(
    df: DataFrame, model: PipelineModel, features: list[str], k: int = 6, digits: int = 2, subject: str = "delay",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``df`` with base, contributions (one per feature, in order) and factors: the k largest of them by
    size, with direction text.

    Base and contributions add up to the prediction of a regressor, to the predicted class's
    probability of a forest classifier, and to the margin of boosted trees.
    """
    tree = model.stages[-1]
    factors = F.array(
        *[
            F.struct(
                F.lit(feature).alias("feature"),
                F.bround(F.col("sums")[i], digits).alias("impact"),
                F.when(F.col("sums")[i] > 0, f"increases {subject}").otherwise(f"reduces {subject}").alias("direction"),
            )
            for i, feature in enumerate(features)
        ]
    )

    def explained(vectors: DataFrame) -> DataFrame:
        # a task works through every leaf whatever its rows, so there are no more tasks than cores
        vectors = vectors.coalesce(df.sparkSession.sparkContext.defaultParallelism)
        x = F.array(*[F.col(f).cast("double") for f in features])
        rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in features]).alias("row"), x.alias("x"))
        pick = F.lit(0)
        if type(tree).__name__ == "RandomForestClassificationModel":
            copy = tree.copy().setFeaturesCol("vector").setPredictionCol("guess").setProbabilityCol("").setRawPredictionCol("")
            rows = copy.transform(rows.withColumn("vector", array_to_vector("x")))
            pick = F.col("guess").cast("int")
        found = shapley_values(rows.select("row", "x", pick.alias("pick")), forest_nodes(tree), len(features), part_bytes)
        return found.select("row.*", "base", F.col("sums").alias("contributions"), top_factors(factors, k).alias("factors"))

    return per_vector(df, features, explained)
