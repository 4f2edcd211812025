"""Merkle manifest of a dataset.

Rows are leaves; the leaves of a group, in order, make a tree of known arity, and the groups' roots, in
order, make another. The trees are built by a monoid of sparse forests: a fragment holds the nodes whose
sibling run isn't complete yet, keyed by group, level and index; merging two fragments is the union of
their nodes, after which every run that is complete becomes its parent. The merge is associative, so
ranges of rows reduce to fragments on their own and the fragments meet in rounds of FAN_IN. A fragment of
a range keeps at most a few nodes for each level, so no task and not the driver holds a tree.

Nodes that no range could complete alone are a small table; a range gets from it what its own rows'
paths lack.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: About so many rows make a range, which one task turns into a fragment and later into paths.
RANGE_ROWS = 50_000
#: So many fragments meet in a task of a round.
FAN_IN = 16
#: Columns that leaves are made of, in this order, where a table has them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "_range long, _g string, n long, level int, at long, digest string, open boolean, made boolean"
_PATH = "array<struct<before:string,after:string>>"


def node(children: list[str]) -> str:
    """H of digests as hex text."""
    return sha256("".join(children).encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """H of the values: each its length in bytes of UTF-8, a colon and itself; a hyphen for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def path_digest(path: Column) -> Column:
    """H of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def merged(n: int, nodes: dict[tuple[int, int], str], arity: int) -> tuple[dict, dict]:
    """The monoid's reduction of one tree of n leaves: {(level, index): digest} of nodes that wait for
    siblings (the root, which has none, too), and of those made here from complete runs."""
    levels: dict[int, dict[int, str]] = defaultdict(dict)
    for (level, at), digest in nodes.items():
        levels[level][at] = digest
    waiting, made, level, size = {}, {}, 0, n
    while size > 1:
        runs: dict[int, list[int]] = defaultdict(list)
        for at in sorted(levels[level]):
            runs[at // arity].append(at)
        for run, members in runs.items():
            if len(members) == min(arity, size - run * arity):
                made[level + 1, run] = levels[level + 1][run] = node([levels[level][at] for at in members])
            else:
                waiting |= {(level, at): levels[level][at] for at in members}
        level, size = level + 1, -(-size // arity)
    return waiting | {(level, at): digest for at, digest in levels[level].items()}, made


def depth(n: int, arity: int) -> int:
    """The level of the root over n leaves."""
    level = 0
    while n > 1:
        level, n = level + 1, -(-n // arity)
    return level


def _node_rows(key: int, group: str, n: int, waiting: dict, made: dict, arity: int, all_made: bool) -> list[tuple]:
    """Rows of _NODES: open ones go to the next round; made ones are new in the table of nodes."""
    top = depth(n, arity)
    rows = {(lv, at): (key, group, n, lv, at, d, lv < top, all_made or (lv, at) in made) for (lv, at), d in waiting.items()}
    if not all_made:
        rows |= {(lv, at): (key, group, n, lv, at, d, False, True) for (lv, at), d in made.items() if (lv, at) not in rows}
    return list(rows.values())


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    names = ("_range", "_g", "n", "level", "at", "digest", "open", "made")
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _runs_of(table: pa.Table) -> list[dict]:
    return sorted((r for r in table.to_pylist()), key=lambda r: r["first"])


def _fragment(arity: int):
    """(leaves of a range, its runs) -> nodes of its fragment."""

    def run(leaves: pa.Table, runs: pa.Table) -> pa.Table:
        order = leaves.sort_by("_at")
        digests, rows = order.column("_digest").to_pylist(), []
        for r in _runs_of(runs):
            own = digests[r["first"] : r["first"] + r["count"]]
            waiting, made = merged(r["n"], {(0, r["start"] + i): d for i, d in enumerate(own)}, arity)
            rows += _node_rows(r["_range"], r["_g"], r["n"], waiting, made, arity, True)
        return _table(rows)

    return run


def _round(arity: int):
    """Open nodes of FAN_IN fragments -> those still open, and those made."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        trees: dict[tuple[str, int], dict] = defaultdict(dict)
        for r in table.to_pylist():
            trees[r["_g"], r["n"]][r["level"], r["at"]] = r["digest"]
        rows = []
        for (group, n), nodes in trees.items():
            rows += _node_rows(key[0].as_py(), group, n, *merged(n, nodes, arity), arity, False)
        return _table(rows)

    return run


def _lacking(arity: int):
    """Runs -> (range, group, level, index) of siblings that lie outside a run's own rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b, size, level = r["start"], r["start"] + r["count"] - 1, r["n"], 0
                while size > 1:
                    up_a, up_b = a // arity, b // arity
                    around = [*range(up_a * arity, a), *range(b + 1, min((up_b + 1) * arity, size))]
                    rows += [(r["_range"], r["_g"], level, at) for at in around]
                    a, b, size, level = up_a, up_b, -(-size // arity), level + 1
            columns = zip(*rows) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_range", "_g", "level", "at"])

    return run


def _paths(arity: int):
    """(leaves of a range, its runs with what they lack and the path above) -> a path for each row."""

    def run(leaves: pa.Table, runs: pa.Table) -> pa.Table:
        order = leaves.sort_by("_at")
        digests, batches = order.column("_digest").to_pylist(), []
        names = ["_id", "subroot", "root", "path"]
        kinds = [pa.int64(), pa.string(), pa.string()]
        struct = pa.struct([("before", pa.string()), ("after", pa.string())])
        ids = order.column("_id").to_pylist()
        for r in _runs_of(runs):
            lacking = {(x["level"], x["at"]): x["digest"] for x in r["lacking"] or ()}
            above = [(p["before"], p["after"]) for p in r["above"] or ()]
            start, first, count, size = r["start"], r["first"], r["count"], r["n"]
            here = {start + i: digests[first + i] for i in range(count)}
            pairs, level, a, b = [], 0, start, start + count - 1
            while size > 1:
                up_a, up_b = a // arity, b // arity
                here |= {at: d for (lv, at), d in lacking.items() if lv == level}
                around, parents = [], {}
                for up in range(up_a, up_b + 1):
                    members = range(up * arity, min((up + 1) * arity, size))
                    texts = [here[at] for at in members]
                    parents[up] = node(texts)
                    around += [("".join(texts[:i]), "".join(texts[i + 1 :])) for i, at in enumerate(members) if a <= at <= b]
                pairs.append((a, arity**level, around))
                here, a, b, size, level = parents, up_a, up_b, -(-size // arity), level + 1
            length = len(pairs) + len(above)
            for at in range(0, count, 5_000):
                part = range(start + at, start + min(at + 5_000, count))
                steps = [s for i in part for s in (*(around[i // width - low] for low, width, around in pairs), *above)]
                flat = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)], fields=list(struct))
                offsets = pa.array(range(0, length * len(part) + 1, length) if length else [0] * (len(part) + 1), pa.int32())
                own = [ids[first + i - start] for i in part], [r["subroot"]] * len(part), [r["root"]] * len(part)
                batches.append(pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(own, kinds)), pa.ListArray.from_arrays(offsets, flat)], names=names))
        return pa.Table.from_batches(batches, pa.schema([*zip(names, kinds), ("path", pa.list_(struct))]))

    return run


class Tree(NamedTuple):
    """rows: the given ones with _g, _range, _at, _id; runs: a group's stretch in a range; nodes: those that
    no range completes alone, and the groups' roots (open is false, level the highest)."""

    rows: DataFrame
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def build(scratch: Scratch, rows: DataFrame, order: list[str], arity: int, name: str) -> Tree:
    """rows: _g (group, not null), _digest (hex), the order's columns and any others.

    Ties in order go by digest; rows alike in both are alike in the tree, and are dealt out by their
    position, so a row that repeats very often is no range of its own.
    """
    keys = ["_g", *order, "_digest", "_salt"]
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    sorted_rows = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = scratch.write(sorted_rows.drop("_salt").withColumn("_id", F.monotonically_increasing_id()), f"{name}-rows")
    placed = placed.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    runs = placed.groupBy("_range", "_g").agg(F.count(F.lit(1)).alias("count"), F.min("_at").alias("first"))
    of_group = Window.partitionBy("_g")  # as many rows as a group has ranges
    start = F.sum("count").over(of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    runs = scratch.write(runs.withColumns({"start": start, "n": F.sum("count").over(of_group)}), f"{name}-runs")

    leaves = placed.select("_range", "_at", "_digest")
    fragments = leaves.groupBy("_range").cogroup(runs.groupBy("_range")).applyInArrow(_fragment(arity), _NODES)
    found = [scratch.write(fragments, f"{name}-fragments")]
    last = runs.agg(F.max("_range")).first()[0] or 0
    while last > 0:
        opened = found[-1].where("open").withColumn("_range", F.floor(F.col("_range") / FAN_IN).cast("long"))
        found.append(scratch.write(opened.groupBy("_range").applyInArrow(_round(arity), _NODES), f"{name}-round-{len(found)}"))
        last //= FAN_IN
    nodes = found[0].where("made")
    for more in found[1:]:
        nodes = nodes.unionByName(more.where("made"))
    # A group's root is the only node of its level, and never open.
    roots = nodes.where("not open and at = 0").groupBy("_g").agg(F.max_by("digest", "level").alias("digest"), F.max("n").alias("n"))
    return Tree(placed, runs, nodes, scratch.write(roots, f"{name}-roots"))


def paths(tree: Tree, above: DataFrame, arity: int) -> DataFrame:
    """tree's rows with subroot, root and path; above: _g, root and the path from a group's root to it."""
    lacking = tree.runs.mapInArrow(_lacking(arity), "_range long, _g string, level int, at long")
    lacking = lacking.join(tree.nodes.select("_g", "level", "at", "digest"), ["_g", "level", "at"])
    lacking = lacking.groupBy("_range", "_g").agg(F.collect_list(F.struct("level", "at", "digest")).alias("lacking"))  # a few for each level
    heads = tree.roots.select("_g", F.col("digest").alias("subroot")).join(above.select("_g", "root", "above"), "_g")
    runs = tree.runs.join(lacking, ["_range", "_g"], "left").join(heads, "_g")
    leaves = tree.rows.select("_range", "_at", "_id", "_digest")
    found = leaves.groupBy("_range").cogroup(runs.groupBy("_range")).applyInArrow(_paths(arity), f"_id long, subroot string, root string, path {_PATH}")
    return tree.rows.join(found, "_id")


def manifest(
    df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf: Column | None = None, others: dict[str, Column] | None = None, arity: int = 2
) -> DataFrame:
    """A row for each of df: the identifier, others' columns, leaf, subroot (its group's), root, and path,
    the siblings before and after at each level from the leaf to the root.

    Leaves are ordered by identifier within a group, groups by UTF-8 bytes; nulls come first in both, rows
    of one identifier go by their leaf, and rows alike in all are each a leaf. Null texts and
    numbers have a mark of their own in a leaf, so null and empty differ. Columns beyond the leaf's aren't
    read and can't clash. An empty table has no root and gives no rows. arity is 2 or more.
    """
    if arity < 2:
        raise ValueError("an arity of 2 or more is needed")
    scratch = Scratch(df.sparkSession)
    leaf = leaf_hash(*[F.col(c) for c in FIELDS]) if leaf is None else leaf
    # Null groups sort before the empty one: '' against '+'.
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    rows = df.select(group.alias("_g"), F.col(id_col).alias("_order"), leaf.alias("_digest"), *[c.alias(f"_x_{k}") for k, c in (others or {}).items()])
    low = build(scratch, rows, ["_order"], arity, "leaves")
    tops = low.roots.select(F.lit("").alias("_g"), F.col("_g").alias("_group"), F.col("digest").alias("_digest"))
    high = build(scratch, tops, ["_group"], arity, "groups")
    whole = high.roots.select("_g", F.col("digest").alias("root"), F.array().cast(_PATH).alias("above"))
    above = paths(high, whole, arity).select(F.col("_group").alias("_g"), "root", F.col("path").alias("above"))
    above = scratch.write(above, "above")  # a row for each group
    made = [F.col(f"_x_{k}").alias(k) for k in others or {}]
    return paths(low, above, arity).select(F.col("_order").alias(id_col), *made, F.col("_digest").alias("leaf"), "subroot", "root", "path")


def audited(df: DataFrame, leaf: Column, tampered: Column, id_col: str = "doc_id", group_col: str = "lang", arity: int = 2) -> DataFrame:
    """Per row of df: identifier, leaf, subroot, root, proof_sha256, folded_root, verified.

    folded_root comes from the tampered leaf where that isn't null, else from the leaf, by the untampered
    siblings. As in manifest for nulls, ties, repeated rows, other columns and empty tables.
    """
    found = manifest(df, id_col, group_col, leaf, {"tampered": tampered}, arity)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select(id_col, "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
