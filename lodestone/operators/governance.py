"""Licence audit, registry synchronisation, change audit, runs and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stored

#: The tier of each known licence identifier, and what tiers allow or ask for.
LICENSE_TIERS = {
    "CC0-1.0": "green",
    "US-PD": "green",
    "PDDL-1.0": "green",
    "CC-BY-4.0": "amber",
    "CC-BY-3.0": "amber",
    "CC-BY-SA-4.0": "red",
    "CC-BY-SA-3.0": "red",
    "CC-BY-NC-SA-4.0": "black",
    "CC-BY-NC-4.0": "black",
    "PROPRIETARY": "black",
    "UNKNOWN": "black",
}
TIERS = ("green", "amber", "red", "mixed", "black")
COMMERCIAL, SHARE_ALIKE, ATTRIBUTED = ("green", "amber", "red"), ("red",), ("amber", "red")
SAFE_FIELDS = ("name", "homepage", "role", "attribution", "cadence_days", "status", "notes")


def expected_tier(spdx: Column) -> Column:
    """The tier that an identifier maps to, null for unknown ones."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LICENSE_TIERS.items() for x in pair]), spdx)


def license_audit(blocks: DataFrame) -> DataFrame:
    """blocks: source_id, context, kind (source, portion, default, exclusion, excluded), licensed (the block
    is there), spdx, tier, commercial_ok, sharealike, attribution, portions and exclusions (how many the
    source lists), stale, unverified, reason.

    One row for each finding: source_id, context, rule, finding, severity. A block without identifier or
    valid tier ends there; so do MIXED and unknown identifiers. Where a flag isn't stated it isn't held
    against the tier. Exclusions must be black and say that they aren't commercial; excluded sources need
    a reason. Staleness and unverified figures are warnings, the rest are errors.
    """
    col, no = F.col, F.lit(False)
    kind, spdx, tier = col("kind"), col("spdx"), col("tier")
    audited = kind.isin("source", "portion", "default") & col("licensed")
    valid = F.coalesce(tier.isin(*TIERS), no)
    known = audited & spdx.isNotNull() & valid & (spdx != "MIXED")
    expected = expected_tier(spdx)
    mapped = known & expected.isNotNull()
    source = (kind == "source") & col("licensed")
    nothing = lambda c: (F.coalesce(col(c), F.lit("")) == "")
    rules = [
        ((kind == "source") & ~col("licensed"), "LC-01", "no_license", "error"),
        (audited & spdx.isNull(), "LC-01", "missing_identifier", "error"),
        (audited & spdx.isNotNull() & ~valid, "LC-01", "invalid_tier", "error"),
        (known & expected.isNull(), "LC-02", "unknown_identifier", "error"),
        (mapped & (expected != tier), "LC-02", "tier_contradicts_identifier", "error"),
        (mapped & (col("commercial_ok") != expected.isin(*COMMERCIAL)), "LC-03", "commercial_flag_contradicts_tier", "error"),
        (mapped & (col("sharealike") != expected.isin(*SHARE_ALIKE)), "LC-02", "sharealike_contradicts_identifier", "error"),
        (mapped & expected.isin(*ATTRIBUTED) & nothing("attribution"), "LC-05", "attribution_missing", "error"),
        (source & (spdx == "MIXED") & (F.coalesce("portions", F.lit(0)) + F.coalesce("exclusions", F.lit(0)) == 0), "LC-01", "mixed_without_portions", "error"),
        ((kind == "exclusion") & ~F.coalesce(tier == "black", no), "LC-03", "exclusion_not_black", "error"),
        ((kind == "exclusion") & F.coalesce(col("commercial_ok"), F.lit(True)), "LC-03", "exclusion_commercial", "error"),
        (source & col("stale"), "LC-04", "stale", "warning"),
        (source & col("unverified"), "figures", "unverified", "warning"),
        ((kind == "excluded") & col("commercial_ok") & ~F.coalesce(tier == "red", no), "LC-06", "excluded_is_commercial", "error"),
        ((kind == "excluded") & nothing("reason"), "LC-06", "excluded_without_reason", "error"),
    ]
    row = lambda rule, finding, severity: F.struct(F.lit(rule).alias("rule"), F.lit(finding).alias("finding"), F.lit(severity).alias("severity"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, no), row(*r)) for c, *r in rules]))
    return blocks.select("source_id", "context", F.explode(found).alias("_f")).select("source_id", "context", "_f.*")


def attribution_manifest(licenses: DataFrame) -> DataFrame:
    """Sources of each tier in order of their names, tiers in their fixed order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return licenses.groupBy("tier", rank.alias("rank")).agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"))


def attribution_lines(licenses: DataFrame, name: str, title: str) -> DataFrame:
    """(tier_rank, rank, line): the manifest as Markdown lines, to be ordered by the ranks and the name.

    A line for each source with its identifier and, where it has one, its attribution; headings are rows.
    """
    at = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    entry = F.concat(F.lit("- **"), F.col(name), F.lit("** \u2014 "), F.coalesce("spdx", F.lit("None")))
    quote = F.when(F.coalesce("attribution", F.lit("")) != "", F.concat(F.lit("\n  > "), "attribution")).otherwise("")
    rows = licenses.where(at > 0).select(at.alias("tier_rank"), F.lit(1).alias("rank"), F.col(name).alias("name"), F.concat(entry, quote).alias("line"))
    heads = rows.select("tier_rank").distinct().select(
        "tier_rank", F.lit(0).alias("rank"), F.lit("").alias("name"), F.concat(F.lit("## Tier: "), F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier_rank").cast("int"))).alias("line")
    )
    top = licenses.sparkSession.createDataFrame([(0, 0, "", f"# {title}")], "tier_rank long, rank int, name string, line string")
    return top.unionByName(heads).unionByName(rows)


def registry_diff(registry: DataFrame, existing: DataFrame, key: str, licensing: list[str], safe: list[str]) -> DataFrame:
    """What a synchronisation would do with each registry row: insert, license_change (which blocks),
    update (with the safe fields that changed), or unchanged. Rows only in existing are let be."""
    other = existing.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in [*licensing, *safe]])
    joined = registry.join(other, registry[key] == other["_key"], "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    blocked = F.lit(False)
    for c in licensing:
        blocked = blocked | differs(c)
    changed = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in safe]))
    new = F.col("_key").isNull()
    action = F.when(new, "insert").when(blocked, "license_change").when(F.size(changed) > 0, "update").otherwise("unchanged")
    return joined.select(key, action.alias("action"), F.when(action == "update", F.array_join(changed, ",")).otherwise("").alias("changed"))


class LicenseChange(ValueError):
    """A synchronisation would meet changed licences that nobody has acknowledged."""


def apply_sync(registry: DataFrame, existing: DataFrame, key: str, licensing: list[str], safe: list[str], acknowledged: bool = False) -> DataFrame:
    """The table after a synchronisation: new rows inserted, safe fields updated, the rest as it was.

    Changed licence fields aren't applied by themselves, and unless they are acknowledged nothing is: the
    error names ten of the rows at most. Rows only in existing are let be.
    """
    plan = registry_diff(registry, existing, key, licensing, safe)
    if not acknowledged:
        changes = [str(r[0]) for r in plan.where("action = 'license_change'").select(key).orderBy(key).limit(10).collect()]
        if changes:
            raise LicenseChange("licence changes need review: " + ", ".join(changes))
    source = registry.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in registry.columns if c != key])
    actions = plan.select(F.col(key).alias("_k"), F.col("action").alias("_action"))
    joined = existing.join(source, existing[key] == F.col("_key"), "full").join(actions, F.coalesce(existing[key], F.col("_key")) == F.col("_k"), "left")
    new = F.col("_action").eqNullSafe("insert")
    value = lambda c: F.when(new, F.col(f"_{c}")).when(F.col("_action").eqNullSafe("update") & F.lit(c in safe), F.col(f"_{c}")).otherwise(existing[c])
    return joined.select(*[(F.coalesce(existing[key], F.col("_key")) if c == key else value(c) if c in registry.columns else existing[c]).alias(c) for c in existing.columns])


def known_sources(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """rows, if the registry has the source of each; else an error that names ten of them at most."""
    unknown = [str(r[0]) for r in rows.select(key).distinct().join(registry.select(key), key, "left_anti").orderBy(key).limit(10).collect()]
    if unknown:
        raise ValueError("unknown sources: " + ", ".join(unknown))
    return rows


def change_kind(old: Column, new: Column, old_deleted: Column, new_deleted: Column) -> Column:
    """insert, update, soft_delete or restore, from the row before and after."""
    return (
        F.when(old.isNull(), "insert").when(~old_deleted & new_deleted, "soft_delete").when(old_deleted & ~new_deleted, "restore").otherwise("update")
    )


def audit_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str], deleted: str, user: str, reason: str) -> DataFrame:
    """Audit rows of what differs between two states of a table; user and reason are mandatory."""
    if not user or not (reason or "").strip():
        raise ValueError("an audited change needs a user and a reason")
    old = before.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"), F.col(deleted).alias("_od"))
    new = after.select(F.col(key).alias("_l"), F.struct(*columns).alias("_new"), F.col(deleted).alias("_nd"))
    joined = old.join(new, F.col("_k") == F.col("_l"), "full").where(~F.to_json("_old").eqNullSafe(F.to_json("_new")) | ~F.col("_od").eqNullSafe(F.col("_nd")))
    kind = F.when(F.col("_new").isNull(), "delete").otherwise(change_kind(F.col("_old"), F.col("_new"), F.col("_od"), F.col("_nd")))
    return joined.select(
        F.coalesce("_k", "_l").alias(key), kind.alias("operation"), F.to_json("_old").alias("old_values"), F.to_json("_new").alias("new_values"),
        F.lit(user).alias("changed_by"), F.lit(reason).alias("reason"),
    )


def insert_absent(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of rows whose keys aren't there yet, once each: what an idempotent append writes."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each run: updates are appended, never made in place."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor, descendant, depth) of every node, whatever the depth.

    Paths of up to 2, 4, 8, ... edges: the paths of just the longest length so far are joined with all so
    far, so a chain of n edges takes log2(n) joins, each a checkpoint. A node that is its own ancestor
    raises an error.
    """
    paths = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(
        F.col(parent).cast("string").alias("ancestor"), F.col(child).cast("string").alias("descendant"), F.lit(1).alias("depth")
    )
    paths, length = stored(paths.distinct()), 1
    while True:
        if paths.where("ancestor = descendant").limit(1).count():
            raise ValueError("the edges have a cycle")
        ends = paths.where(F.col("depth") == length).select("ancestor", F.col("descendant").alias("_via"), F.col("depth").alias("_first"))
        on = paths.select(F.col("ancestor").alias("_via"), "descendant", F.col("depth").alias("_rest"))
        further = stored(ends.join(on, "_via").select("ancestor", "descendant", (F.col("_first") + F.col("_rest")).alias("depth")).distinct())
        if not further.limit(1).count():
            return paths
        paths, length = paths.unionByName(further).distinct(), 2 * length


def shortest_paths(edges: DataFrame, source: str, target: str, kind: str, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, node, hops, path, kinds) of every node that a start reaches over directed, typed edges, by a shortest
    path: node identifiers and edge kinds as strings, from the start. hops bounds the paths' length.

    starts: one column of identifiers. A frontier goes out one edge at a time; nodes that a start has reached
    already aren't reached again, so cycles end by themselves and a start isn't its own node. Of equally short paths
    the one whose nodes, then kinds, sort first is kept. Edges with a null end lead nowhere; a null kind is "".
    """
    e = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
        F.col(source).cast("string").alias("_from"), F.col(target).cast("string").alias("_to"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("_kind")
    )
    e = stored(e.groupBy("_from", "_to").agg(F.min("_kind").alias("_kind")))  # between two nodes the first kind
    first = starts.select(F.col(starts.columns[0]).cast("string").alias("start")).where("start is not null").distinct()
    none = F.array().cast("array<string>")
    frontier = stored(first.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.array("start").alias("path"), none.alias("kinds")))
    levels, at = [frontier], 0
    while hops is None or at < hops:
        at += 1
        seen = reduce(DataFrame.unionByName, [x.select("start", "node") for x in levels])
        step = frontier.join(e, F.col("node") == F.col("_from")).select(
            "start", F.col("_to").alias("node"), F.lit(at).alias("hops"), F.concat("path", F.array("_to")).alias("path"), F.concat("kinds", F.array("_kind")).alias("kinds")
        )
        best = step.groupBy("start", "node", "hops").agg(F.min(F.struct("path", "kinds")).alias("_b")).select("start", "node", "hops", "_b.path", "_b.kinds")
        frontier = stored(best.join(seen, ["start", "node"], "left_anti"), "frontier")
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels).where("hops > 0")
