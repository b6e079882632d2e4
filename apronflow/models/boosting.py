"""Second-order boosted trees on binned features.

Features are cut at approximate quantiles once. Rows of equal bins are counted into one row per sampling
group, so the table that is passed over holds at most (bins per feature)**features x ``GROUPS`` rows, however
many were read. It is kept in blocks of arrays. Each level of a tree is one aggregation: gradients and
Hessians are summed per node, feature and bin, combined in each task and then in ``DIRECT`` tasks, and
only their sums (bounded by the depth, features and bins) reach the driver, which picks the splits of
largest gain. A tree draws its columns and its sampling groups of rows anew. A finished model scores
Arrow batches of rows, all rows of a batch at once.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apronflow.models.shapley import NODES
from apronflow.models.training import training_table
from apronflow.operators.ranking import id_number
from apronflow.sources.scratch import materialize, use_checkpoint_folder

# hash groups of rows; a tree samples whole groups
GROUPS = 20
# rounds whose margins are only cached, between two checkpoints
REFRESH = 20
# tasks that send their sums to the driver, at most; those of more tasks are combined by so many first
DIRECT = 4

@dataclass
class BoostedTrees:
    """Nodes of a tree are numbered from 1, the children of i are 2i (x <= threshold) and 2i + 1; feature
    -1 is a leaf."""

    features: list[str]
    depth: int
    trees: list[dict[str, list]] = field(default_factory=list)

    def margins(self, rounds: list[int]) -> Column:
        """Array of the summed outputs of the first so many trees; null and NaN go above every threshold."""
        last = max(rounds, default=0)
        feature, threshold, value = (np.array([t[c] for t in self.trees[:last]]) for c in ("feature", "threshold", "value"))
        depth = self.depth

        def summed(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])
            x[np.isnan(x)] = np.inf
            row, total = np.arange(len(x)), np.zeros(len(x))
            sums = [total]
            for t in range(len(feature)):
                node = np.ones(len(x), np.int64)
                for _ in range(depth):
                    f = feature[t][node]
                    node = np.where(f < 0, node, 2 * node + (x[row, f] > threshold[t][node]))
                total = total + value[t][node]
                sums.append(total)
            return pd.Series(list(np.column_stack([sums[min(r, len(feature))] for r in rounds])))

        return F.pandas_udf(summed, "array<double>")(*[F.col(f).cast("double") for f in self.features])

    def margin(self, rounds: int | None = None) -> Column:
        return self.margins([len(self.trees) if rounds is None else rounds])[0]

    def probability(self, rounds: int | None = None) -> Column:
        return 1 / (1 + F.exp(-self.margin(rounds)))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table, as ``shapley_values`` takes it; cover is the sum of Hessians."""
        rows = []
        for t, tree in enumerate(self.trees):
            for i in range(1, len(tree["feature"])):
                if tree["cover"][i] > 0:
                    inner = tree["feature"][i] >= 0
                    rows.append((t, i, tree["feature"][i], tree["threshold"][i] if inner else None, 2 * i if inner else -1, 2 * i + 1 if inner else -1, tree["cover"][i], [tree["value"][i]]))
        return spark.createDataFrame(rows, NODES)


def _edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most ``bins`` - 1 cut points per feature: approximate quantiles of its known values."""
    shares = [i / bins for i in range(1, bins)]
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    row = df.agg(*[F.percentile_approx(known(f), F.lit(shares), 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in row]


def _binned(df: DataFrame, features: list[str], label: str, identifier: str, edges: list[list[float]], seed: int) -> DataFrame:
    """(codes, part): n rows, of which pos are positive. A code counts the cut points below the value."""

    def code(feature: str, cuts: list[float]) -> Column:
        value = F.coalesce(F.col(feature).cast("double"), F.lit(float("inf")))
        return F.size(F.filter(F.from_json(F.lit(json.dumps(cuts)), "ARRAY<DOUBLE>"), lambda e: e < value))

    codes = [code(f, cuts) for f, cuts in zip(features, edges)]
    part = F.pmod(id_number(identifier, seed), F.lit(GROUPS)).cast("int")
    rows = df.filter(F.col(label).isNotNull()).select(F.array(*codes).alias("codes"), part.alias("part"), F.col(label).cast("double").alias("y"))
    return rows.groupBy("codes", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def best_splits(g: np.ndarray, h: np.ndarray, l2: float, min_child: float) -> list[tuple[float, int, int] | None]:
    """Per node of (nodes x features x bins) sums: (gain, feature, last bin below) of the best split, the
    first of equal ones, or None without a gain."""
    below_g, below_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
    all_g, all_h = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
    above_g, above_h = all_g - below_g, all_h - below_h
    gain = (below_g**2 / (below_h + l2) + above_g**2 / (above_h + l2) - all_g**2 / (all_h + l2)) / 2
    gain = np.where((below_h >= min_child) & (above_h >= min_child), gain, 0.0)
    found: list[tuple[float, int, int] | None] = []
    for node in gain:
        at = int(node.argmax()) if node.size else 0
        best = float(node.flat[at]) if node.size else 0.0
        found.append((best, *divmod(at, node.shape[1])) if best > 1e-12 else None)
    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of binned rows as one row of packed arrays."""
    for batch in batches:
        if batch.num_rows:
            codes = batch.column(0).flatten().to_numpy().astype(np.int16)
            cells = [codes, *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["codes", "part", "n", "pos"])


def _block(row, width: int) -> dict[str, np.ndarray]:
    part, n, pos = (np.frombuffer(row[i]) for i in (1, 2, 3))
    return {"codes": np.frombuffer(row[0], np.int16).reshape(-1, width), "part": part, "n": n, "pos": pos, "margin": np.zeros(len(n))}


def _nodes_of(tree: dict[str, np.ndarray], depth: int, codes: np.ndarray) -> np.ndarray:
    """The node each row has reached after ``depth`` levels."""
    node, row = np.ones(len(codes), np.int64), np.arange(len(codes))
    for _ in range(depth):
        feature = tree["feature"][node]
        node = np.where(feature < 0, node, 2 * node + (codes[row, feature] > tree["cut"][node]))
    return node


def _moved(block: dict[str, np.ndarray], tree: dict[str, np.ndarray], depth: int) -> dict[str, np.ndarray]:
    return {**block, "margin": block["margin"] + tree["value"][_nodes_of(tree, depth, block["codes"])]}


def _sums(blocks: Iterable[dict[str, np.ndarray]], tree: dict[str, np.ndarray], level: int, active: list[int], columns: list[int], parts: list[int], width: int) -> Iterator[np.ndarray]:
    """(2 x nodes x columns x bins): gradients and Hessians of the sampled rows in the active nodes."""
    out = np.zeros((2, len(active), len(columns), width))
    place = np.full(len(tree["feature"]), -1)
    place[active] = np.arange(len(active))
    for block in blocks:
        at = place[_nodes_of(tree, level, block["codes"])]
        rows = np.flatnonzero(np.isin(block["part"], parts) & (at >= 0))
        p = 1 / (1 + np.exp(-block["margin"][rows]))
        g, h = block["n"][rows] * p - block["pos"][rows], block["n"][rows] * p * (1 - p)
        for i, f in enumerate(columns):
            cell = at[rows] * width + block["codes"][rows, f]
            for side, values in enumerate((g, h)):
                out[side, :, i] += np.bincount(cell, values, len(active) * width).reshape(-1, width)
    yield out


def _added(pairs: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """The sum in order of the tasks, so that it does not depend on which one ends first."""
    return reduce(np.add, [values for _, values in sorted(pairs, key=lambda pair: pair[0])])


def _partials(sums: RDD) -> RDD:
    """At most ``DIRECT`` sums, however many tasks there are."""
    if sums.getNumPartitions() <= DIRECT:
        return sums
    dealt = sums.mapPartitionsWithIndex(lambda i, rows: [(i % DIRECT, (i, values)) for values in rows])
    return dealt.groupByKey(DIRECT).map(lambda group: _added(group[1]))


def _grow(blocks: RDD, columns: list[int], parts: list[int], edges: list[list[float]], depth: int, step: float, l2: float, min_child: float) -> dict[str, list]:
    """One tree, level by level."""
    size = 2 ** (depth + 1)
    tree = {"feature": [-1] * size, "cut": [-1] * size, "threshold": [0.0] * size, "value": [0.0] * size, "cover": [0.0] * size}
    width = max(len(edges[f]) for f in columns) + 1
    active = [1]
    for level in range(depth):
        so_far = _arrays(tree)
        sums = blocks.mapPartitions(lambda rows, t=so_far, n=level, a=active: _sums(rows, t, n, a, columns, parts, width))
        g, h = _partials(sums).reduce(np.add)
        if not level:
            # the first column's bins hold every row once
            _weigh(tree, 1, g[0, 0].sum(), h[0, 0].sum(), step, l2)
        following = []
        for i, split in enumerate(best_splits(g, h, l2, min_child)):
            if split is None or split[2] >= len(edges[columns[split[1]]]):
                continue
            _, column, cut = split
            n, f = active[i], columns[column]
            tree["feature"][n], tree["cut"][n], tree["threshold"][n] = f, cut, edges[f][cut]
            _weigh(tree, 2 * n, g[i, column, : cut + 1].sum(), h[i, column, : cut + 1].sum(), step, l2)
            _weigh(tree, 2 * n + 1, g[i, column, cut + 1 :].sum(), h[i, column, cut + 1 :].sum(), step, l2)
            following += [2 * n, 2 * n + 1]
        active = following
        if not active:
            break
    return tree


def _arrays(tree: dict[str, list]) -> dict[str, np.ndarray]:
    return {k: np.array(tree[k]) for k in ("feature", "cut", "value")}


def _weigh(tree: dict[str, list], node: int, g: float, h: float, step: float, l2: float) -> None:
    tree["value"][node], tree["cover"][node] = float(-step * g / (h + l2)), float(h)


def train_boosted(
    df: DataFrame, features: list[str], label: str, identifier: str, rounds: int = 200, depth: int = 6, step: float = 0.05,
    row_share: float = 0.8, column_share: float = 0.8, l2: float = 1.0, min_child: float = 1.0, bins: int = 64, seed: int = 42,
) -> BoostedTrees:
    """Logistic boosting of ``label`` (0 or 1; rows without one are left out).

    Columns are drawn per tree; rows are drawn per tree in hash groups of ``identifier``. Starts from a
    probability of one half. A table without rows gives trees of a single leaf with value 0.
    """
    known = training_table(df.filter(F.col(label).isNotNull()), [*features, label, identifier])
    edges = _edges(known, features, bins)
    rows = materialize(_binned(known, features, label, identifier, edges, seed), "binned")
    use_checkpoint_folder(df.sparkSession)
    rng = random.Random(seed)
    model = BoostedTrees(features, depth)
    columns, parts = max(1, int(column_share * len(features))), max(1, round(row_share * GROUPS))
    held: list[RDD] = []
    packed = rows.select("codes", "part", "n", "pos").mapInArrow(_packed, "codes binary, part binary, n binary, pos binary")
    blocks = packed.rdd.map(lambda row, k=len(features): _block(row, k)).persist(StorageLevel.MEMORY_AND_DISK)
    for r in range(rounds):
        chosen, drawn = sorted(rng.sample(range(len(features)), columns)), sorted(rng.sample(range(GROUPS), parts))
        model.trees.append(_grow(blocks, chosen, drawn, edges, depth, step, l2, min_child))
        # the finished tree is applied once, onto the margins of the round before
        before, last = blocks, _arrays(model.trees[-1])
        blocks = before.map(lambda block, t=last: _moved(block, t, depth)).persist(StorageLevel.MEMORY_AND_DISK)
        if r % REFRESH == REFRESH - 1:
            blocks.checkpoint()
            blocks.count()
        held.append(before)
        if len(held) > 1:
            held.pop(0).unpersist()
    for rest in (*held, blocks):
        rest.unpersist()
    return model


def log_loss(df: DataFrame, model: BoostedTrees, label: str, rounds: list[int]) -> DataFrame:
    """(rounds, loss): mean logistic loss after so many trees, in one pass over ``df``."""
    y = F.col(label).cast("double")
    loss = lambda m: F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - y * m
    rows = df.filter(y.isNotNull()).select(y.alias("y"), model.margins(rounds).alias("m"))
    y = F.col("y")
    means = rows.agg(*[F.avg(loss(F.col("m")[i])).alias(f"r{i}") for i in range(len(rounds))])
    return means.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rounds"), F.col(f"r{i}").alias("loss")) for i, r in enumerate(rounds)])))
