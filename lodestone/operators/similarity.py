"""Tanimoto and nearest-neighbour joins over array columns.

Bit vectors are arrays of the positions of their set bits. References lie in cells: bands of their number of
bits, or those nearest to a pivot. A query is sent to the cells that a bound can't rule out, as far as its
best so far tells; a cell of many rows, or of many queries, is met in blocks, and only a query's best
of a block goes on. Sparse wide vectors have a join through their rarest bits instead.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import scratch_path, stored

#: About so many rows of a side meet in a task, and make a band or a pivot's cell.
BLOCK_ROWS = 40_000
#: At most so many pivots, which are broadcast.
PIVOTS = 512


def on_bits(values: Column) -> Column:
    """Positions of the positive entries."""
    return F.filter(F.transform(values, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def packed(bits: Column) -> Column:
    """Positions as an array of 64-bit words."""
    word = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.floor(F.coalesce(F.array_max(bits), F.lit(0)) / 64).cast("int")), word)


def shared_bits(a: Column, b: Column) -> Column:
    """How many bits two packed vectors share."""
    none = F.lit(0).cast("long")
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, none).bitwiseAND(F.coalesce(y, none)))), F.lit(0), lambda s, n: s + n)


def exact_collisions(queries: DataFrame, references: DataFrame, bits: str) -> DataFrame:
    """One row: queries, and how many of them have a reference with all the same bits."""
    q = queries.select(packed(F.col(bits)).alias("_key"))
    r = references.select(packed(F.col(bits)).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return q.join(r, "_key", "left").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("collisions"))


def same_keys(queries: DataFrame, references: DataFrame, query_id: str, keys: dict[str, str]) -> DataFrame:
    """Each row of queries by its id, and by the names in keys how many references have an equal value of that column.

    Values are compared whole. A null is equal to none; nulls within an array are alike. References are counted
    before they meet the queries, and a value of many queries is met in parts of about BLOCK_ROWS of them.
    """
    own = F.pmod(F.xxhash64(query_id), F.coalesce("_parts", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    q = queries.select(query_id, *keys.values())
    for name, key in keys.items():
        hashed = F.xxhash64(key).alias("_hash")
        parts = queries.groupBy(hashed).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_parts")).where("_parts > 1")
        counts = references.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
        placed = counts.withColumn("_hash", hashed).join(F.broadcast(parts), "_hash", "left").select(key, name, every.alias("_part"))
        dealt = q.withColumn("_hash", hashed).join(F.broadcast(parts), "_hash", "left").withColumn("_part", own).drop("_hash", "_parts")
        q = dealt.join(placed, [key, "_part"], "left").drop(key, "_part").withColumn(name, F.coalesce(name, F.lit(0)))
    return q


def in_cells(asking: DataFrame, answering: DataFrame, meet: Callable, schema: str) -> DataFrame:
    """meet(rows of asking, rows of answering) -> frame, for both sides' rows of a cell, in blocks.

    asking and answering have _id and _cell. A cell's sides are dealt into parts of about BLOCK_ROWS, and
    each pair of parts meets once.
    """
    count = lambda df, name: df.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    parts = count(asking, "_asks").join(count(answering, "_answers"), "_cell")  # a row for each cell
    own = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asking.join(F.broadcast(parts), "_cell").withColumn("_q", own("_asks")).withColumn("_r", every("_answers")).drop("_asks", "_answers")
    r = answering.join(F.broadcast(parts), "_cell").withColumn("_r", own("_answers")).withColumn("_q", every("_asks")).drop("_asks", "_answers")
    names = [c.split()[0] for c in schema.split(", ")]

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(columns=names) if a.empty or b.empty else meet(a, b)

    return q.groupBy("_cell", "_q", "_r").cogroup(r.groupBy("_cell", "_q", "_r")).applyInPandas(both, schema)


def _similarities(a: pd.DataFrame, b: pd.DataFrame, rows: int = 512):
    """(start, matrix) of the similarities of some rows of a to all of b, from products of 0/1 matrices over the
    positions that occur."""
    held = [np.concatenate([np.asarray(x, np.int64) for x in df["_bits"]]) for df in (a, b)]
    places = np.unique(np.concatenate(held))

    def dense(df: pd.DataFrame, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((len(df), len(places)), np.float32)
        out[np.repeat(np.arange(len(df)), [len(x) for x in df["_bits"]]), np.searchsorted(places, flat)] = 1
        return out

    q, r = dense(a, held[0]), dense(b, held[1])
    n_q, n_r = q.sum(1), r.sum(1)
    for i in range(0, len(q), rows):
        both = (q[i : i + rows] @ r.T).astype(np.float64)
        union = n_q[i : i + rows, None] + n_r[None, :] - both
        yield i, np.where(union > 0, both / np.maximum(union, 1), 0.0)


def _most_similar(a: pd.DataFrame, b: pd.DataFrame, k: int, rows: int = 256, columns: int = 2_048) -> list[list[dict]]:
    """For each row of a its k most similar rows of b, by falling similarity, then by identifier. Only the k of a row are
    put in order. Numbers of bits up to 1,000 are divided as floats: unequal quotients differ there, equal ones don't."""
    b = b.sort_values("_id", kind="stable")
    held = [np.concatenate([np.asarray(x, np.int64) for x in df["_bits"]]) for df in (a, b)]
    places = np.unique(np.concatenate(held))

    def dense(df: pd.DataFrame, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((len(df), len(places)), np.float32)
        out[np.repeat(np.arange(len(df)), [len(x) for x in df["_bits"]]), np.searchsorted(places, flat)] = 1
        return out

    q, r = dense(a, held[0]), dense(b, held[1])
    n_q, n_r, ids, out, k = q.sum(1), r.sum(1), b["_id"].to_numpy(), [], min(k, len(b))
    kind = np.float32 if len(places) <= 1_000 else np.float64
    step = columns if k == 1 else len(r)
    for i in range(0, len(q), rows):
        top, at, shared = np.full(len(q[i : i + rows]), -1, kind), None, None
        for j in range(0, len(r), step):
            both = q[i : i + rows] @ r[j : j + step].T
            alike = np.add(n_q[i : i + rows, None], n_r[j : j + step], dtype=kind)
            alike -= both
            np.maximum(alike, 1, out=alike)
            np.divide(both, alike, out=alike)
            if k == 1:
                to = alike.argmax(1)[:, None]  # the first of equals has the smallest identifier
            else:
                least = np.partition(alike, len(ids) - k, axis=1)[:, len(ids) - k]
                on, to = np.divmod(np.flatnonzero((alike >= least[:, None]).reshape(-1)), alike.shape[1])
                order = np.lexsort((to, -alike[on, to], on))
                on, to = on[order], to[order]
                to = to[np.arange(len(on)) - np.searchsorted(on, on) < k].reshape(-1, k)
            found = np.take_along_axis(alike, to[:, :1], 1)[:, 0]
            more, held_here = found > top, np.take_along_axis(both, to, 1)
            at, shared = (to + j, held_here) if at is None else (np.where(more[:, None], to + j, at), np.where(more[:, None], held_here, shared))
            top = np.maximum(top, found)
        shared = shared.astype(np.float64)
        union = n_q[i : i + rows, None].astype(np.float64) + n_r[at] - shared
        best = np.where(union > 0, shared / np.maximum(union, 1), 0.0)
        out += [[{"similarity": s, "neighbour_id": j} for s, j in zip(*x)] for x in zip(best.tolist(), ids[at].tolist())]
    return out


def _bit_rows(df: DataFrame, key: str, bits: str) -> DataFrame:
    return df.where(F.col(bits).isNotNull()).select(F.col(key).alias("_id"), F.array_distinct(bits).alias("_bits")).withColumn("_n", F.size("_bits"))


def bands(rows: DataFrame) -> list[tuple[int, int]]:
    """Ranges of numbers of bits, ascending, that hold about BLOCK_ROWS rows each; a single number may hold more.
    What reaches the driver is a row for each number of bits, as many as vectors have positions."""
    out: list[list[int]] = []
    for n, count in sorted((r["_n"], r["count"]) for r in rows.groupBy("_n").count().collect()):
        if out and out[-1][2] + count <= BLOCK_ROWS:
            out[-1][1:] = [n, out[-1][2] + count]
        else:
            out.append([n, n, count])
    return [(low, high) for low, high, _ in out]


def _band_of(n: Column, found: list[tuple[int, int]]) -> Column:
    """The band that holds n bits, else the one whose members can be most alike."""
    return F.coalesce(*[F.when(n <= high, i) for i, (_, high) in enumerate(found[:-1])], F.lit(max(0, len(found) - 1)))


def _bound(n: Column, band: Column, found: list[tuple[int, int]]) -> Column:
    """The largest similarity of a vector of n bits to one of the band: smaller number over larger."""
    low, high = (F.element_at(F.array(*[F.lit(x[k]) for x in found]), band + 1) for k in (0, 1))
    return F.when(n < low, n / low).when(n > high, high / n).otherwise(1.0)


def tanimoto_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, bits: str, threshold: float = 0.5) -> DataFrame:
    """Pairs (a_id, b_id, similarity) that reach the threshold, which is above 0; identifiers are longs.

    Partners' numbers of bits lie within a factor of the threshold: a vector is sent to the bands there, and
    meets each block of them once. Null vectors and those without a bit have no partner.
    """
    if threshold <= 0:
        raise ValueError("a join needs a threshold above 0")
    q, r = (_bit_rows(df, key, bits).where("_n > 0") for df, key in ((a, a_id), (b, b_id)))
    found = bands(r) or [(1, 1)]
    cells = F.filter(F.sequence(F.lit(0), F.lit(len(found) - 1)), lambda i: _bound(F.col("_n"), i, found) >= threshold - 1e-9)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        parts, x_ids, y_ids = [], x["_id"].to_numpy(), y["_id"].to_numpy()
        for i, alike in _similarities(x, y):
            at, to = np.nonzero(alike >= threshold)
            parts.append(pd.DataFrame({"a_id": x_ids[i + at], "b_id": y_ids[to], "similarity": alike[at, to]}))
        return pd.concat(parts, ignore_index=True)

    return in_cells(q.withColumn("_cell", F.explode(cells)), r.withColumn("_cell", _band_of(F.col("_n"), found)), meet, "a_id long, b_id long, similarity double")


class BitIndex(NamedTuple):
    """References' bit vectors as a table in folders by band, and the bands."""

    path: str
    bands: list[tuple[int, int]]


def index_bits(references: DataFrame, key: str, bits: str, path: str) -> BitIndex:
    """Writes the index; null vectors aren't in it."""
    rows = _bit_rows(references, key, bits)
    found = bands(rows)
    rows.withColumn("_cell", _band_of(F.col("_n"), found)).repartition("_cell", F.pmod(F.xxhash64("_id"), F.lit(8))).write.partitionBy("_cell").parquet(path)
    return BitIndex(path, found)


def neighbours(queries: DataFrame, index: BitIndex, key: str, bits: str, k: int, asked: list[DataFrame] | None = None) -> DataFrame:
    """Per query and rank 1 to k: neighbour_id and similarity, by falling similarity, then by identifier.

    A query asks the band of its own number of bits, then bands at distances of 1, 2 to 3, 4 to 7 and so on; of
    those it asks only where the bound reaches its k-th best so far. Identifiers are longs; null vectors have no
    neighbours. asked collects each round's (query, band) rows.
    """
    spark, found = queries.sparkSession, index.bands
    q = stored(_bit_rows(queries, key, bits), "queries")
    empty = "_id long, best array<struct<similarity:double,neighbour_id:long>>"
    if not found:
        return spark.createDataFrame([], f"{key} long, rank int, neighbour_id long, similarity double")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_id": x["_id"].to_numpy(), "best": _most_similar(x, y, k)})

    first = lambda c: F.slice(F.transform(F.array_sort(F.transform(c, lambda x: F.struct((-x["similarity"]).alias("s"), x["neighbour_id"].alias("i")))), lambda x: F.struct((-x["s"]).alias("similarity"), x["i"].alias("neighbour_id"))), 1, k)
    state = spark.createDataFrame([], empty)
    near, far = 0, 1
    while near < len(found):
        own = _band_of(F.col("_n"), found)
        at = F.array_union(F.sequence(own - (far - 1), own - near), F.sequence(own + near, own + (far - 1)))
        least = F.when(F.size("best") >= k, F.element_at("best", -1)["similarity"]).otherwise(-1.0)
        cells = F.filter(at, lambda i: (i >= 0) & (i < len(found)) & (_bound(F.col("_n"), F.greatest(F.lit(0), F.least(i, F.lit(len(found) - 1))), found) >= F.col("_least")))
        asking = q.join(state, "_id", "left").withColumn("_least", F.coalesce(least, F.lit(-1.0))).withColumn("_cell", F.explode(cells)).select("_id", "_bits", "_cell")
        asking = stored(asking, "asking")
        if asked is not None:
            asked.append(asking.select("_id", "_cell"))
        wanted = [r[0] for r in asking.select("_cell").distinct().collect()]  # at most the bands
        if wanted:
            answers = spark.read.parquet(index.path).where(F.col("_cell").isin(wanted)).select("_id", "_bits", "_cell")
            more = in_cells(asking, answers, meet, empty).unionByName(state)
            state = stored(more.groupBy("_id").agg(first(F.flatten(F.collect_list("best"))).alias("best")), "best")  # k from each block
        near, far = far, 2 * far
    return state.select(F.col("_id").alias(key), F.posexplode("best").alias("_at", "_b")).select(key, (F.col("_at") + 1).alias("rank"), "_b.neighbour_id", "_b.similarity")


def max_similarity(queries: DataFrame, references: DataFrame, query_id: str, bits: str) -> DataFrame:
    """Per query its largest similarity to a reference; 0 where no bit is shared. Both sides' identifiers have the
    name query_id. A null vector has similarity 0."""
    index = index_bits(references, query_id, bits, scratch_path(references.sparkSession, "bits"))
    best = neighbours(queries, index, query_id, bits, 1).select(F.col(query_id).alias("_id"), "similarity")
    return queries.select(query_id).join(best, F.col(query_id) == F.col("_id"), "left").select(query_id, F.coalesce("similarity", F.lit(0.0)).alias("max_similarity"))


def tanimoto_join_by_prefix(a: DataFrame, b: DataFrame, a_id: str, b_id: str, bits: str, threshold: float = 0.5) -> DataFrame:
    """As tanimoto_join, for sparse vectors over many positions, none of which many vectors hold.

    Vectors of n bits that reach it share one of their n - ceil(threshold n) + 1 rarest bits. The pair comes
    from the rarest of those alone, so no pair comes twice and none is grouped. Null vectors and those
    without a bit have no partner.
    """
    if threshold <= 0:
        raise ValueError("a join needs a threshold above 0")
    held = lambda df, name: df.select(F.explode(bits).alias("_bit")).groupBy("_bit").agg(F.count(F.lit(1)).alias(name))
    # One row for each bit position, with a rank in one array of all: as many as the vectors have positions.
    ranks = held(a, "_n").unionByName(held(b, "_n")).groupBy("_bit").agg(F.sum("_n").alias("_n"))
    order = ranks.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_bit"))), lambda x: x["_bit"]).alias("_order"))

    def side(df: DataFrame, key: str, x: str) -> DataFrame:
        n = F.size(bits)
        length = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
        ranked = F.array_sort(F.transform(F.col(bits), lambda p: F.array_position("_order", p).cast("int")))
        rows = df.where(n > 0).join(F.broadcast(order)).select(F.col(key).alias(f"{x}_id"), n.alias(f"n{x}"), packed(F.col(bits)).alias(f"w{x}"), F.slice(ranked, F.lit(1), length).alias(f"p{x}"))
        return rows.withColumn("_bit", F.explode(f"p{x}"))

    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    first = F.array_intersect("pa", "pb")[0] == F.col("_bit")
    shared = shared_bits(F.col("wa"), F.col("wb"))
    pairs = side(a, a_id, "a").join(side(b, b_id, "b"), "_bit").where(fits & first)
    return pairs.select("a_id", "b_id", (shared / (F.col("na") + F.col("nb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


#: Tiers of the largest similarity to a reference, with their lower and upper bounds.
SIMILARITY_TIERS = (("highly_similar", 0.7, 1.01), ("moderately_similar", 0.4, 0.7), ("chemically_novel", 0.2, 0.4), ("out_of_domain", -0.01, 0.2))


def similarity_tier(similarity: Column) -> Column:
    """The tier whose bounds hold the similarity; null for null and for what none holds."""
    return F.coalesce(*[F.when((similarity >= low) & (similarity < high), name) for name, low, high in SIMILARITY_TIERS])


def scaler(train: DataFrame, values: str) -> DataFrame:
    """Per position: mean and population deviation over train; a deviation of 0 counts as 1."""
    return (
        train.select(F.posexplode(values).alias("i", "x"))
        .groupBy("i")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("_sd"))
        .select("i", "mean", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd")).alias("sd"))
    )


def scaled(df: DataFrame, values: str, stats: DataFrame, out: str = "scaled") -> DataFrame:
    """df with the standardised array. The statistics are one row as wide as the array."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("i", "mean", "sd"))).alias("_s"))
    unit = lambda x, s: (x.cast("double") - s["mean"]) / s["sd"]
    return df.join(F.broadcast(one)).withColumn(out, F.zip_with(values, "_s", unit)).drop("_s")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def _nearest(x: np.ndarray, y: np.ndarray, k: int, limit: np.ndarray, ids: np.ndarray | None = None, others: np.ndarray | None = None, rows: int = 256, columns: int = 4_096) -> list[np.ndarray]:
    """For each row of x its up to k smallest distances to rows of y that are within its limit, ascending; a row whose id is
    among others doesn't meet that one.

    Products of floats, whose error is below margin, tell which pairs can be among them; those are computed again from
    the doubles' differences. Rows with a number that isn't finite have none.
    """
    fine = np.isfinite(y).all(1)
    y, others = y[fine], None if others is None else others[fine]
    out = [np.empty(0)] * len(x)
    if not len(y):
        return out
    middle = y.mean(0)
    x, y = x - middle, y - middle
    n_x, n_y = (x**2).sum(1), (y**2).sum(1)
    most = np.max(n_x[np.isfinite(n_x)], initial=0) + n_y.max()
    kind = np.float32 if 1e-30 < most < 1e30 else np.float64
    margin = (x.shape[1] + 8) * 2.4e-7 * most
    with np.errstate(all="ignore"):
        a = np.concatenate([-2 * x, np.ones((len(x), 1)), n_x[:, None]], axis=1).astype(kind)
    b = np.concatenate([y, n_y[:, None], np.ones((len(y), 1))], axis=1).astype(kind)
    least = k + (others is not None)
    for i in range(0, len(x), rows):
        own = a[i : i + rows]
        m = len(own)
        best, within = np.full((m, k), np.inf), limit[i : i + rows] ** 2 * (1 + 1e-9) + 1e-12
        for j in range(0, len(y), columns):
            with np.errstate(invalid="ignore"):
                d = own @ b[j : j + columns].T
            if j == 0 and least <= d.shape[1]:
                within = np.fmin(within, np.partition(d, least - 1, axis=1)[:, least - 1] + 2 * margin)
            on, to = np.divmod(np.flatnonzero((d <= (within + margin)[:, None].astype(kind)).reshape(-1)), d.shape[1])
            if others is not None:
                apart = ids[i + on] != others[j + to]
                on, to = on[apart], to[apart]
            if not len(on):
                continue
            exact = np.concatenate([((x[i + on[c : c + 65_536]] - y[j + to[c : c + 65_536]]) ** 2).sum(1) for c in range(0, len(on), 65_536)])
            order = np.lexsort((exact, on))
            on, exact = on[order], exact[order]
            place = np.arange(len(on)) - np.searchsorted(on, on)
            more = np.full((m, k), np.inf)
            more[on[place < k], place[place < k]] = exact[place < k]
            best = np.sort(np.concatenate([best, more], axis=1), axis=1)[:, :k]
            within = np.fmin(within, best[:, -1])
        best = np.sqrt(np.where(best <= (limit[i : i + rows] ** 2 * (1 + 1e-9) + 1e-12)[:, None], best, np.inf))
        out[i : i + m] = [row[np.isfinite(row)] for row in best]
    return out


def nearest_distance(queries: DataFrame, references: DataFrame, id_col: str, values: str, k: int = 5, exclude_self: bool = False) -> DataFrame:
    """Per query the mean Euclidean distance to its k nearest references; queries without a vector, or
    without a reference, have no row. Identifiers are longs.

    A bounded sample of references are pivots, and a reference's cell is that of its nearest pivot. A query
    first asks its nearest cells until they hold k rows, which bounds its k-th distance; then all cells that
    neither their ring around the pivot nor the half-space between pivots puts beyond that. There only pairs
    within the bound are computed exactly. Without structure the work is that of all pairs.
    """
    spark = references.sparkSession
    sides = [df.where(F.col(values).isNotNull()).select(F.col(id_col).alias("_id"), F.col(values).cast("array<double>").alias("_v")) for df in (queries, references)]
    r, q = stored(sides[1], "references"), stored(sides[0], "queries")
    n = r.count()
    many = min(PIVOTS, max(1, n // BLOCK_ROWS))
    chosen = r.orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(many).collect()  # PIVOTS at most
    if not chosen:
        return spark.createDataFrame([], f"{id_col} long, knn_distance double")
    pivots = np.array([x["_v"] for x in chosen])

    def placed(frames):
        for f in frames:
            if len(f):
                d = _distances(np.stack(f["_v"].to_numpy()), pivots)
                yield f.assign(_cell=d.argmin(1).astype("int32"), _d=d.min(1))

    r = stored(r.mapInPandas(placed, "_id long, _v array<double>, _cell int, _d double"), "cells")
    cells = {x["_cell"]: x for x in r.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("low"), F.max("_d").alias("high")).collect()}  # PIVOTS rows at most
    rows, low, high = (np.array([float(cells[i][c]) if i in cells else e for i in range(many)]) for c, e in (("n", 0), ("low", np.inf), ("high", -np.inf)))
    least = k + exclude_self

    def asks(frames, second: bool):
        for f in frames:
            if not len(f):
                continue
            d = _distances(np.stack(f["_v"].to_numpy()), pivots)
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(rows[order], axis=1) - rows[order]
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, before < least, axis=1)
            ask = first & (rows > 0)
            if second:
                beyond = np.maximum(np.maximum(d - high, low - d), (d - d.min(1)[:, None]) / 2)
                ask = ~first & (rows > 0) & (beyond <= f["_kth"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9)
            at, to = np.nonzero(ask)
            limit = f["_kth"].to_numpy() if second else np.full(len(f), np.inf)
            yield pd.DataFrame({"_id": f["_id"].to_numpy()[at], "_v": f["_v"].to_numpy()[at], "_cell": to.astype("int32"), "_limit": limit[at]})

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, ids = np.stack(a["_v"].to_numpy()), np.stack(b["_v"].to_numpy()), a["_id"].to_numpy()
        near = _nearest(x, y, k, a["_limit"].to_numpy(), *((ids, b["_id"].to_numpy()) if exclude_self else ()))
        some = [i for i, row in enumerate(near) if len(row)]
        return pd.DataFrame({"_id": ids[some], "_near": pd.Series([near[i] for i in some], dtype=object)})

    schema, kinds = "_id long, _near array<double>", "_id long, _v array<double>, _cell int, _limit double"
    best = lambda df: df.groupBy("_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))  # noqa: E731  k from each block
    near = stored(best(in_cells(stored(q.mapInPandas(lambda f: asks(f, False), kinds), "asking"), r, meet, schema)), "near")
    if many > 1:
        kth = F.when(F.size("_near") >= k, F.element_at("_near", -1)).otherwise(float("inf"))
        again = q.join(near.select("_id", kth.alias("_kth")), "_id").mapInPandas(lambda f: asks(f, True), kinds)
        near = best(in_cells(again, r, meet, schema).unionByName(near))
    return near.where(F.size("_near") > 0).select(F.col("_id").alias(id_col), (F.aggregate("_near", F.lit(0.0), lambda s, d: s + d) / F.size("_near")).alias("knn_distance"))
