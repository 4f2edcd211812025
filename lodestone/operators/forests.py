"""Random forests whose trees are grown whole, each in a task.

Numbers become codes of at most as many bins as the estimator has, one byte each, and the coded rows go to every
task of trees. A task grows its trees level by level, lets the rows that are judged fall through each tree, and
returns sums of votes: neither the driver nor a task ever holds a forest. Votes and weights are summed as
integers, and draws depend on seed, tree, level and the rows' order by a hash, so results don't depend on the
partitioning. Smaller or shallower forests of one seed are parts of the largest: its first trees, or its levels.
"""

from __future__ import annotations

from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import stored

#: About so many trees are grown in a task; tasks of one growth are at most so many.
TASK_TREES, MOST_TASKS = 25, 64
#: So many rows make a block of codes, and so many entries of rows and drawn numbers are put in order at a time.
BLOCK_ROWS, ENTRIES = 100_000, 262_144
#: Votes are summed in units of this part.
UNIT = 1 << 40


class Kind(NamedTuple):
    """A forest: its number of trees, depth and seed."""

    trees: int
    depth: int
    seed: int


class Grown:
    """What a forest gave: the share of votes for 1 of each judged row by its key, and importances."""

    def __init__(self, votes: DataFrame, importances: list[float], features: str, label: str):
        self.votes, self.features, self.label = votes, features, label
        self.featureImportances: DenseVector = Vectors.dense(importances)

    def probability(self, df: DataFrame, out: str) -> DataFrame:
        """Rows of df, which are among those that were judged, with their share of votes."""
        return df.withColumn("_key", key(df, self.features)).join(self.votes.withColumnRenamed("p", out), "_key").drop("_key")


def key(df: DataFrame, features: str) -> Column:
    """Tells rows by their first column, the identifier, and their vector."""
    return F.xxhash64(F.col(df.columns[0]), vector_to_array(F.col(features)))


def edges(train: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Per number of the vector, values that end its bins: all distinct values if they are no more than bins, else
    quantiles. What reaches the driver is at most bins values for each number."""
    values = train.select(vector_to_array(features).alias("x"))

    def few(frames):
        held: list[np.ndarray] = []
        for f in frames:
            for at in range(0, len(f), BLOCK_ROWS):
                x = np.stack(f["x"].iloc[at : at + BLOCK_ROWS].to_numpy())
                held = [np.unique(np.concatenate([h, c]))[: bins + 1] for h, c in zip(held or [[]] * x.shape[1], x.T)]
        if held:
            yield pd.DataFrame({"i": range(len(held)), "x": held})

    distinct = values.mapInPandas(few, "i int, x array<double>").groupBy("i").agg(F.array_sort(F.slice(F.array_distinct(F.flatten(F.collect_list("x"))), 1, bins + 1)).alias("few"))
    values = values.select(F.posexplode("x").alias("i", "x"))
    cuts = values.groupBy("i").agg(F.percentile_approx("x", [k / bins for k in range(bins)], 10_000).alias("cuts"))
    found = distinct.join(cuts, "i").orderBy("i").collect()
    return [np.unique(r["few"] if len(r["few"]) <= bins else r["cuts"]) for r in found]


def coded(df: DataFrame, features: str, label: Column, weight: Column, ends: list[np.ndarray], side: int) -> DataFrame:
    """Blocks of rows as bytes: keys, codes, labels, weights. A code is the number of ends below the value."""
    rows = df.select(key(df, features).alias("k"), label.cast("int").alias("y"), weight.cast("double").alias("w"), vector_to_array(features).alias("x"))

    def blocks(frames):
        for f in frames:
            for at in range(0, len(f), BLOCK_ROWS):
                part = f.iloc[at : at + BLOCK_ROWS]
                x = np.stack(part["x"].to_numpy())
                codes = np.stack([np.searchsorted(e[:-1], x[:, i], "left") for i, e in enumerate(ends)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"side": [side], "k": [part["k"].to_numpy(np.int64).tobytes()], "c": [codes.tobytes()], "y": [part["y"].to_numpy(np.uint8).tobytes()], "w": [part["w"].to_numpy(np.float64).tobytes()]})

    return rows.mapInPandas(blocks, "side int, k binary, c binary, y binary, w binary")


class Tree(NamedTuple):
    """Nodes level by level. feature is -1 at a leaf, left is the first of two children, ones is the share of 1."""

    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    ones: np.ndarray
    gain: np.ndarray
    starts: list[int]


def drawn(rng: np.random.Generator, nodes: int, width: int, n: int) -> np.ndarray:
    """n distinct numbers below width for each node (Floyd's sampling)."""
    out = np.empty((nodes, n), np.int64)
    for j, top in enumerate(range(width - n, width)):
        x = rng.integers(0, top + 1, nodes)
        out[:, j] = np.where((out[:, :j] == x[:, None]).any(1), top, x)
    return out


def tree(codes: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, depth: int, seed: int, number: int) -> Tree:
    """One tree on a Poisson resample of the rows; w: integer weights, whose sums stay below 2^53. Each node splits by the
    largest Gini gain among n drawn numbers, or is a leaf if none gains."""
    rows, width = codes.shape
    flat, bag = codes.reshape(-1), np.random.default_rng([seed, number]).poisson(1.0, rows)
    r = np.flatnonzero(bag)
    w = w[r] * bag[r]
    one = np.where(y[r] == 1, w, 0)
    node, total, ones = np.zeros(len(r), np.int64), np.array([w.sum()]), np.array([one.sum()])
    parts, starts, at = [], [0], 0
    for level in range(depth + 1):
        k = len(total)
        at += k
        feature, code, left, gains = np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.zeros(k, np.int64), np.zeros(k)
        parts.append((feature, code, left, np.divide(ones, total, out=np.zeros(k), where=total > 0), gains))
        mixed = (ones > 0) & (ones < total)
        if level == depth or not mixed.any():
            break
        stay = mixed[node]
        r, w, one, node = r[stay], w[stay], one[stay], (np.cumsum(mixed) - 1)[node[stay]]
        live = np.flatnonzero(mixed)
        total, ones, k = total[live], ones[live], len(live)
        of = drawn(np.random.default_rng([seed, number, level]), k, width, n)
        best, split, taken = np.full((k, n), -1.0), np.zeros((k, n), np.int64), max(1, ENTRIES // len(r))
        bits = int(len(r)).bit_length()
        for first in range(0, n, taken):
            cols = of[:, first : first + taken]
            m = cols.shape[1]
            order = (((node[:, None] * m + np.arange(m)) << 8 | flat[(r * width)[:, None] + cols[node]]) << bits | np.arange(len(r))[:, None]).reshape(-1)
            order.sort()
            row, cell = order & ((1 << bits) - 1), order >> bits
            end = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1)
            held = cell[end] >> 8
            t, o = np.repeat(total, m), np.repeat(ones, m)
            a, p = np.cumsum(w[row])[end] - (np.cumsum(t) - t)[held], np.cumsum(one[row])[end] - (np.cumsum(o) - o)[held]
            b, q = (t[held] - a).astype(float), (o[held] - p).astype(float)
            a, p = a.astype(float), p.astype(float)
            inner = b > 0
            score = np.where(inner, (p * p + (a - p) ** 2) / a + np.divide(q * q + (b - q) ** 2, b, out=np.zeros(len(b)), where=inner), -1.0)
            most = np.maximum.reduceat(score, np.searchsorted(held, np.arange(k * m)))
            hit = np.flatnonzero(score == most[held])[::-1]
            where = np.empty(k * m, np.int64)
            where[held[hit]] = cell[end[hit]] & 255  # the first of equals
            best[:, first : first + m], split[:, first : first + m] = most.reshape(k, m), where.reshape(k, m)
        j = best.argmax(1)
        top = best[np.arange(k), j]
        t, o = total.astype(float), ones.astype(float)
        gain = np.where(top >= 0, top - (o * o + (t - o) ** 2) / t, 0.0)
        goes = gain > 1e-12 * t
        if not goes.any():
            break
        by, cut = of[np.arange(k), j], split[np.arange(k), j]
        rank = np.cumsum(goes) - 1
        feature[live[goes]], code[live[goes]], left[live[goes]], gains[live[goes]] = by[goes], cut[goes], at + 2 * rank[goes], gain[goes]
        stay = goes[node]
        r, w, one, node = r[stay], w[stay], one[stay], node[stay]
        node = 2 * rank[node] + (flat[r * width + by[node]] > cut[node])
        total, ones = (np.bincount(node, x, 2 * int(goes.sum())).astype(np.int64) for x in (w, one))
        starts.append(at)
    return Tree(*(np.concatenate(x) for x in zip(*parts)), starts)


def shares(grown: Tree, codes: np.ndarray, depths: list[int]) -> dict[int, np.ndarray]:
    """The share of 1 in each row's leaf, by the depth that the tree is cut at."""
    flat, width, node, live, out = codes.reshape(-1), codes.shape[1], np.zeros(len(codes), np.int64), np.arange(len(codes)), {}
    for level in range(max(depths) + 1):
        if level in depths:
            out[level] = grown.ones[node]
        live = live[grown.feature[node[live]] >= 0]
        at = node[live]
        node[live] = grown.left[at] + (flat[live * width + grown.feature[at]] > grown.code[at])
    return out


def weights_of(grown: Tree, width: int, depth: int) -> np.ndarray:
    """Each number's part of the gains above the depth."""
    end = grown.starts[depth] if depth < len(grown.starts) else len(grown.feature)
    inner = grown.feature[:end] >= 0
    gains = np.bincount(grown.feature[:end][inner], grown.gain[:end][inner], width)
    return gains / gains.sum() if gains.sum() > 0 else gains


def places(spark, n: int) -> list[int]:
    """A number for each of n partitions that a repartition by it sends there."""
    found = spark.range(0, 40 * n, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()  # n rows
    return [r["id"] for r in sorted(found)]


def grow(train: DataFrame, judged: DataFrame, features: str, label: str, weight: str, kinds: list[Kind], bins: int = 32) -> list[Grown]:
    """What each kind of forest gives for the judged rows, when it learns from train's label and weight.

    The first column of both names their rows. Trees draw the square root of the vector's width at each node.
    """
    spark, ends = train.sparkSession, edges(train, features, bins)
    if not ends:
        raise ValueError("a forest needs rows to learn from")
    width = len(ends)
    data = stored(coded(train, features, F.col(label), F.col(weight), ends, 0).unionByName(coded(judged, features, F.lit(0), F.lit(1.0), ends, 1)), "codes")
    seeds = sorted({x.seed for x in kinds})
    every = [(s, t) for s in seeds for t in range(max(x.trees for x in kinds if x.seed == s))]
    tasks = min(MOST_TASKS, -(-len(every) // TASK_TREES))
    at = places(spark, tasks)
    mine = {p: every[i :: len(at)] for i, p in enumerate(at)}
    names = ["importance", "kind", "key", "votes", "trees"]

    def side(f: pd.DataFrame, s: int):
        f = f[f["side"] == s]
        k, c, y, w = (np.frombuffer(b"".join(f[n]), kind) for n, kind in zip("kcyw", (np.int64, np.uint8, np.uint8, np.float64)))
        order = np.lexsort((y, k))
        return k[order], c.reshape(-1, width)[order], y[order], w[order]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        (_, x, y, w), (keys, z, _, _) = side(f, 0), side(f, 1)
        w = np.rint(w * (2.0**50 / (64 * w.sum()))).astype(np.int64)
        votes = {i: np.zeros(len(keys), np.int64) for i in range(len(kinds))}
        parts, counts = {i: np.zeros(width, np.int64) for i in votes}, dict.fromkeys(votes, 0)
        for seed, number in mine[int(f["_task"].iloc[0])]:
            of = [i for i, kind in enumerate(kinds) if kind.seed == seed and number < kind.trees]
            depths = sorted({kinds[i].depth for i in of})
            grown = tree(x, y, w, ceil(sqrt(width)), depths[-1], seed, number)
            fell = {d: np.rint(s * UNIT).astype(np.int64) for d, s in shares(grown, z, depths).items()}
            for i in of:
                votes[i] += fell[kinds[i].depth]
                parts[i] += np.rint(weights_of(grown, width, kinds[i].depth) * UNIT).astype(np.int64)
                counts[i] += 1
        used = [i for i in votes if counts[i]]
        out = [pd.DataFrame({"importance": False, "kind": i, "key": keys, "votes": votes[i], "trees": counts[i]}) for i in used]
        return pd.concat(out + [pd.DataFrame({"importance": True, "kind": i, "key": np.arange(width), "votes": parts[i], "trees": counts[i]}) for i in used])[names]

    dealt = data.withColumn("_task", F.explode(F.array(*[F.lit(x).cast("long") for x in at]))).repartition(tasks, "_task")
    sums = dealt.groupBy("_task").applyInPandas(run, "importance boolean, kind int, key long, votes long, trees int")
    sums = stored(sums.groupBy("importance", "kind", "key").agg((F.sum("votes") / F.sum("trees") / UNIT).alias("p")), "votes")
    out = []
    found: dict[int, dict] = {i: {} for i in range(len(kinds))}
    for row in sums.where("importance").collect():  # one for each kind and number of the vector
        found[row["kind"]][row["key"]] = row["p"]
    for i in range(len(kinds)):
        raw = np.array([found[i][j] for j in range(width)])
        out.append(Grown(sums.where(f"not importance and kind = {i}").select(F.col("key").alias("_key"), "p"), (raw / raw.sum() if raw.sum() > 0 else raw).tolist(), features, label))
    return out
