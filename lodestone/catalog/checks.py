"""Rules of the stored tables with rows that break each, gates with quarantine, paths over typed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.functions import scalars
from lodestone.operators import constraints, gates, governance
from lodestone.session import scratch_path, table


def _breaches(view: str, key: str, bad: dict[str, str]) -> str:
    """SQL of (rule, key) from the conditions that break each rule."""
    return f"WITH x AS ({view}) " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, {key}::VARCHAR AS key FROM x WHERE {condition}" for rule, condition in bad.items())


_COMPOUND = """SELECT c_custkey, upper(md5(c_name)) AS inchikey_full, left(upper(md5(c_name)), CASE WHEN c_custkey % 19 = 0 THEN 13 ELSE 14 END) AS inchikey_skeleton, c_custkey % 7 = 0 AS is_deleted,
  CASE WHEN c_custkey % 21 > 0 THEN 'superseded' END AS deleted_reason, c_custkey % 5 = 0 AS is_mixture, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS parent_inchikey FROM customer"""


@query(_breaches(_COMPOUND, "c_custkey", {
    "skeleton_is_prefix": "substr(inchikey_full, 1, 14) <> inchikey_skeleton", "deleted_has_reason": "is_deleted AND deleted_reason IS NULL", "mixture_has_no_parent": "is_mixture AND parent_inchikey IS NOT NULL",
}))
def compound_constraints(spark, d):
    k, full = F.col("c_custkey"), F.upper(F.md5("c_name"))
    df = table(spark, d, "customer").select(
        k, full.alias("inchikey_full"), F.left(full, F.when(k % 19 == 0, 13).otherwise(14)).alias("inchikey_skeleton"), (k % 7 == 0).alias("is_deleted"),
        F.when(k % 21 > 0, "superseded").alias("deleted_reason"), (k % 5 == 0).alias("is_mixture"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("parent_inchikey"),
    )
    return constraints.violations(df, "c_custkey", constraints.compound_rules())


#: Each descriptor is a size shifted so that some parts fall outside its range, as numerator and offset.
_SHIFTED = {
    "mw_g_mol": (250, 0), "exact_mass_g_mol": (250, -3), "molar_refractivity": (1, -2), "tpsa_a2": (25, -30), "rotatable_bonds": (5, -10), "aromatic_rings": (1, -3), "ring_count": (1, -4), "heavy_atom_count": (1, -5),
    "formal_charge": (1, -25), "hbd_lipinski": (1, -6), "hba_lipinski": (1, -7), "hbd_strict": (1, -8), "hba_strict": (1, -9), "heteroatom_count": (1, -10), "num_stereocentres": (1, -11), "largest_ring_size": (1, -12),
}
_DESCRIPTOR = "SELECT p_partkey, " + ", ".join(f"p_size * {n} + ({o}) AS {c}" for c, (n, o) in _SHIFTED.items() if c not in ("mw_g_mol", "exact_mass_g_mol")) + """,
  p_size * 250 - 500 AS mw_g_mol, p_size * 250 - 500 + (p_partkey % 5) * 0.25 AS exact_mass_g_mol, p_size / 25.0 - 0.2 AS fraction_csp3, CASE WHEN p_size % 2 = 0 THEN p_size - 6 END AS mw_parent_g_mol FROM part"""


@query(_breaches(_DESCRIPTOR, "p_partkey", {
    "mw_g_mol_in_range": "mw_g_mol <= 0 OR mw_g_mol >= 10000", "mw_parent_g_mol_in_range": "mw_parent_g_mol <= 0", "exact_mass_g_mol_in_range": "exact_mass_g_mol <= 0", "tpsa_a2_in_range": "tpsa_a2 < 0 OR tpsa_a2 >= 1000",
    "rotatable_bonds_in_range": "NOT rotatable_bonds BETWEEN 0 AND 200", "heavy_atom_count_in_range": "heavy_atom_count <= 0", "formal_charge_in_range": "abs(formal_charge) > 20", "fraction_csp3_in_range": "fraction_csp3 < 0 OR fraction_csp3 > 1",
    "masses_agree": "exact_mass_g_mol - mw_g_mol >= 0.5",
} | {f"{c}_in_range": f"{c} < 0" for c in ("molar_refractivity", "aromatic_rings", "ring_count", "hbd_lipinski", "hba_lipinski", "hbd_strict", "hba_strict", "heteroatom_count", "num_stereocentres", "largest_ring_size")}))
def descriptor_constraints(spark, d):
    size = F.col("p_size")
    made = {c: size * n + o for c, (n, o) in _SHIFTED.items()}
    made |= {"mw_g_mol": size * 250 - 500, "exact_mass_g_mol": size * 250 - 500 + (F.col("p_partkey") % 5) * 0.25, "fraction_csp3": size / 25.0 - 0.2, "mw_parent_g_mol": F.when(size % 2 == 0, size - 6)}
    df = table(spark, d, "part").select("p_partkey", *[v.alias(k) for k, v in made.items()])
    return constraints.violations(df, "p_partkey", constraints.descriptor_rules(df.columns))


_LIKENESS = """SELECT p_partkey, p_size % 7 - 1 AS lipinski_violations, (p_size % 7 - 1 <= 1) = (p_partkey % 11 > 0) AS lipinski_pass, p_size / 40.0 - 0.1 AS qed_score, p_size / 4.0 AS sa_score, p_size - 3 AS pains_alerts,
  p_size - 4 AS brenk_alerts, CASE WHEN p_size % 3 > 0 THEN p_size / 7.0 - 0.5 END AS cns_mpo_score, [0.11, 0.17, 0.55, 0.56, 0.85, 0.5][p_size % 6 + 1] AS bioavailability_score FROM part"""


@query(_breaches(_LIKENESS, "p_partkey", {
    "lipinski_violations_in_range": "NOT lipinski_violations BETWEEN 0 AND 4", "qed_score_in_range": "qed_score < 0 OR qed_score > 1", "sa_score_in_range": "sa_score < 1 OR sa_score > 10", "pains_alerts_in_range": "pains_alerts < 0",
    "brenk_alerts_in_range": "brenk_alerts < 0", "cns_mpo_score_in_range": "cns_mpo_score < 0 OR cns_mpo_score > 6", "bioavailability_in_set": "bioavailability_score = 0.5", "pass_follows_violations": "lipinski_pass <> (lipinski_violations <= 1)",
}))
def likeness_constraints(spark, d):
    s, n = F.col("p_size"), F.col("p_size") % 7 - 1
    df = table(spark, d, "part").select(
        "p_partkey", n.alias("lipinski_violations"), ((n <= 1) == (F.col("p_partkey") % 11 > 0)).alias("lipinski_pass"), (s / 40.0 - 0.1).alias("qed_score"), (s / 4.0).alias("sa_score"), (s - 3).alias("pains_alerts"),
        (s - 4).alias("brenk_alerts"), F.when(s % 3 > 0, s / 7.0 - 0.5).alias("cns_mpo_score"), F.element_at(F.array(*map(F.lit, (*constraints.BIOAVAILABILITY, 0.5))), s % 6 + 1).alias("bioavailability_score"),
    )
    return constraints.violations(df, "p_partkey", constraints.likeness_rules())


_MEASUREMENT = """SELECT l_orderkey * 10 + l_linenumber AS id, ['measured', 'below_loq', 'above_loq', 'not_measured', 'lost'][l_partkey % 5 + 1] AS measurement_status, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity END AS canonical_value,
  CASE WHEN l_suppkey % 3 > 0 THEN l_tax END AS loq_value, CASE WHEN l_orderkey % 31 = 0 THEN 'predicted' ELSE 'experimental' END AS evidence_type, CASE WHEN l_linenumber = 3 THEN 'logd_74' ELSE 'ic50' END AS endpoint_id,
  CASE WHEN l_partkey % 2 = 0 THEN l_quantity / 3 - 1 END AS ph_reference, l_quantity * 6 - 90 AS temperature_c, l_linenumber - 1 AS n_replicates, l_discount - 0.01 AS std_error, l_tax * 14 AS confidence_score,
  l_orderkey % 13 = 0 AS is_deleted, CASE WHEN l_linenumber % 2 = 0 THEN 'withdrawn' END AS deleted_reason, ['green', 'amber', 'red', 'black', 'blue', NULL][l_orderkey % 6 + 1] AS license_tier,
  ['documented', 'range_assertion', 'cross_source', 'unverified', 'guessed'][l_orderkey % 5 + 1] AS unit_verified_method FROM lineitem"""


@query(_breaches(_MEASUREMENT, "id", {
    "ph_reference_in_range": "ph_reference < 0 OR ph_reference > 14", "temperature_c_in_range": "temperature_c < -80 OR temperature_c > 200", "n_replicates_in_range": "n_replicates <= 0", "std_error_in_range": "std_error < 0",
    "confidence_score_in_range": "confidence_score > 1", "never_predicted": "evidence_type = 'predicted'", "logd_has_ph": "endpoint_id = 'logd_74' AND ph_reference IS NULL", "deleted_has_reason": "is_deleted AND deleted_reason IS NULL",
    "status_is_backed": "measurement_status = 'lost' OR measurement_status = 'measured' AND canonical_value IS NULL OR measurement_status IN ('below_loq', 'above_loq') AND loq_value IS NULL",
    "tier_has_partition": "license_tier IS NULL OR license_tier = 'blue'", "unit_method_known": "unit_verified_method = 'guessed'",
}))
def measurement_constraints(spark, d):
    c = F.col
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    df = table(spark, d, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), pick(("measured", "below_loq", "above_loq", "not_measured", "lost"), c("l_partkey") % 5).alias("measurement_status"),
        F.when(c("l_suppkey") % 4 > 0, c("l_quantity")).alias("canonical_value"), F.when(c("l_suppkey") % 3 > 0, c("l_tax")).alias("loq_value"), F.when(c("l_orderkey") % 31 == 0, "predicted").otherwise("experimental").alias("evidence_type"),
        F.when(c("l_linenumber") == 3, "logd_74").otherwise("ic50").alias("endpoint_id"), F.when(c("l_partkey") % 2 == 0, c("l_quantity") / 3 - 1).alias("ph_reference"), (c("l_quantity") * 6 - 90).alias("temperature_c"),
        (c("l_linenumber") - 1).alias("n_replicates"), (c("l_discount") - 0.01).alias("std_error"), (c("l_tax") * 14).alias("confidence_score"), (c("l_orderkey") % 13 == 0).alias("is_deleted"),
        F.when(c("l_linenumber") % 2 == 0, "withdrawn").alias("deleted_reason"), pick(("green", "amber", "red", "black", "blue", None), c("l_orderkey") % 6).alias("license_tier"), pick((*constraints.UNIT_METHODS, "guessed"), c("l_orderkey") % 5).alias("unit_verified_method"),
    )
    return constraints.violations(df, "id", constraints.measurement_rules())


_ENDPOINT = """SELECT s_suppkey, s_suppkey % 3 = 0 AS is_categorical, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS expected_min, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal + 1 END AS expected_max,
  CASE WHEN s_nationkey % 2 = 0 THEN TRUE END AS higher_is_worse, CASE WHEN s_nationkey % 7 = 0 THEN 'physicochemical' ELSE 'toxicity' END AS endpoint_class, CASE WHEN s_suppkey % 11 = 0 THEN 'guessed' ELSE 'documented' END AS unit_verified_method FROM supplier"""


@query(_breaches(_ENDPOINT, "s_suppkey", {
    "continuous_has_bounds": "NOT is_categorical AND (expected_min IS NULL OR expected_max IS NULL)", "direction_is_decided": "NOT is_categorical AND higher_is_worse IS NULL AND endpoint_class <> 'physicochemical'", "unit_method_known": "unit_verified_method = 'guessed'",
}))
def endpoint_constraints(spark, d):
    k, n, v = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    df = table(spark, d, "supplier").select(
        k, (k % 3 == 0).alias("is_categorical"), F.when(k % 4 > 0, v).alias("expected_min"), F.when(k % 5 > 0, v + 1).alias("expected_max"), F.when(n % 2 == 0, True).alias("higher_is_worse"),
        F.when(n % 7 == 0, "physicochemical").otherwise("toxicity").alias("endpoint_class"), F.when(k % 11 == 0, "guessed").otherwise("documented").alias("unit_verified_method"),
    )
    return constraints.violations(df, "s_suppkey", constraints.endpoint_rules())


_MODEL = """SELECT o_orderkey, o_orderkey % 3 > 0 AS is_commercial_ok, CASE WHEN o_custkey % 4 = 0 THEN ['green', 'black'] ELSE ['green', 'amber'] END AS training_license_tiers, o_orderkey % 5 = 0 AS is_regulatory_ready,
  o_custkey % 2 = 0 AS is_validated, CASE WHEN o_custkey % 9 > 0 THEN 'box' END AS ad_definition, CASE WHEN o_custkey % 10 > 0 THEN md5(o_orderpriority) END AS artifact_sha256 FROM orders"""


@query(_breaches(_MODEL, "o_orderkey", {
    "commercial_follows_tiers": "is_commercial_ok = list_contains(training_license_tiers, 'black')", "regulatory_is_validated": "is_regulatory_ready AND NOT is_validated", "ad_definition_present": "ad_definition IS NULL", "artifact_sha256_present": "artifact_sha256 IS NULL",
}))
def model_constraints(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tiers = lambda *t: F.array(*map(F.lit, t))
    df = table(spark, d, "orders").select(
        k, (k % 3 > 0).alias("is_commercial_ok"), F.when(c % 4 == 0, tiers("green", "black")).otherwise(tiers("green", "amber")).alias("training_license_tiers"), (k % 5 == 0).alias("is_regulatory_ready"),
        (c % 2 == 0).alias("is_validated"), F.when(c % 9 > 0, "box").alias("ad_definition"), F.when(c % 10 > 0, F.md5("o_orderpriority")).alias("artifact_sha256"),
    )
    return constraints.violations(df, "o_orderkey", constraints.model_rules())


def six_gates(spark, d: str) -> list[tuple[DataFrame, str, gates.Gate]]:
    """Rows, key and gate of each of the six, on the given tables."""
    c = F.col
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(c("o_orderkey") % 500 > 0, c("o_orderdate").cast("string")).otherwise("soon").alias("o_orderdate"))
    orders = orders.unionByName(orders.where("o_orderkey % 1000 = 7"))
    parts = table(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 37 == 0, F.concat("p_name", F.lit(" ."), "p_brand")).otherwise(c("p_name")).alias("name"))
    lines = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_discount", "l_tax", "l_quantity")
    owned = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(c("o_custkey") % 90 > 0, "green").alias("tier"))
    known = table(spark, d, "customer").where("c_custkey % 50 <> 0")
    groups = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(c("c_custkey") % 3 == 0, c("c_custkey") % 10).otherwise(c("c_nationkey") % 10).alias("g"), F.when(c("c_custkey") % 41 == 0, "black").otherwise("green").alias("tier"))
    return [
        (pages, "page_id", gates.Gate("acquisition", {"url_has_scheme": c("url").contains("://"), "url_is_plain": ~c("url").contains("?"), "size_in_envelope": F.octet_length("html").between(200, 5_000)})),
        (orders, "o_orderkey", gates.Gate("structural", {"date_parses": F.try_to_timestamp("o_orderdate").isNotNull(), "status_known": c("o_orderstatus").isin("F", "O")}, lambda x: constraints.repeated(x, ["o_orderkey"], "key_is_unique"))),
        (parts, "p_partkey", gates.Gate("chemical", {"one_component": ~c("name").contains("."), "name_is_stable": F.trim("name") == c("name")})),
        (lines, "id", gates.Gate("semantic", {"discount_in_envelope": c("l_discount").between(0, 0.09), "tax_in_envelope": c("l_tax").between(0, 0.07)})),
        (owned, "o_orderkey", gates.Gate("integration", {"tier_present": c("tier").isNotNull()}, lambda x: constraints.orphans(x, known, "o_custkey", "c_custkey", "customer_known").select("rule", c("key").alias("_c")).distinct().join(x.select(c("o_custkey").cast("string").alias("_c"), c("o_orderkey").cast("string").alias("key")), "_c").select("rule", "key"))),
        (groups, "c_custkey", gates.Gate("publication", {"no_black_tier": c("tier") != "black"}, lambda x: x.join(constraints.several_groups(x, "c_nationkey", "g", "one_group_per_key").select("rule", c("key").alias("_n")), c("c_nationkey").cast("string") == c("_n")).select("rule", c("c_custkey").cast("string").alias("key")))),
    ]


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 500 = 0 AS bad_date FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, o_orderkey % 500 = 0 FROM orders WHERE o_orderkey % 1000 = 7),
g AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 ELSE c_nationkey % 10 END AS g FROM customer), b(gate, k, rule) AS (
  SELECT 'acquisition', page_id, 'url_has_scheme' FROM pages WHERE NOT contains(url, '://') UNION ALL SELECT 'acquisition', page_id, 'url_is_plain' FROM pages WHERE contains(url, '?')
  UNION ALL SELECT 'acquisition', page_id, 'size_in_envelope' FROM pages WHERE NOT strlen(html) BETWEEN 200 AND 5000
  UNION ALL SELECT 'structural', o_orderkey, 'date_parses' FROM o WHERE bad_date UNION ALL SELECT 'structural', o_orderkey, 'status_known' FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'structural', o_orderkey, 'key_is_unique' FROM o WHERE o_orderkey % 1000 = 7
  UNION ALL SELECT 'chemical', p_partkey, 'one_component' FROM part WHERE p_partkey % 37 = 0 OR contains(p_name, '.') UNION ALL SELECT 'chemical', p_partkey, 'name_is_stable' FROM part WHERE p_partkey % 37 > 0 AND trim(p_name) <> p_name
  UNION ALL SELECT 'semantic', l_orderkey * 10 + l_linenumber, 'discount_in_envelope' FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09::DOUBLE UNION ALL SELECT 'semantic', l_orderkey * 10 + l_linenumber, 'tax_in_envelope' FROM lineitem WHERE NOT l_tax BETWEEN 0 AND 0.07::DOUBLE
  UNION ALL SELECT 'integration', o_orderkey, 'tier_present' FROM orders WHERE o_custkey % 90 = 0 UNION ALL SELECT 'integration', o_orderkey, 'customer_known' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
  UNION ALL SELECT 'publication', c_custkey, 'no_black_tier' FROM g WHERE c_custkey % 41 = 0 UNION ALL SELECT 'publication', c_custkey, 'one_group_per_key' FROM g WHERE c_nationkey IN (SELECT c_nationkey FROM g GROUP BY 1 HAVING count(DISTINCT g) > 1))
SELECT gate, k::VARCHAR AS key, rule, count(*) AS n FROM b GROUP BY ALL""")
def gate_quarantine(spark, d):
    """What each of the six gates holds back: gate, key, rule broken and the rows that broke it."""
    held = []
    for rows, key, gate in six_gates(spark, d):
        path = scratch_path(spark, gate.name)
        try:
            gates.passed(rows, key, gate, path)
        except gates.GateStopped:
            pass  # its rows are what is asked for
        held.append(gates.quarantine(spark, path).select(F.lit(gate.name).alias("gate"), F.col(key).cast("string").alias("key"), F.explode("broken").alias("rule")))
    return reduce(DataFrame.unionByName, held).groupBy("gate", "key", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e(a, b, kind) AS (SELECT s_nationkey::VARCHAR, ((s_nationkey * 7 + s_suppkey) % 25)::VARCHAR, min(CASE WHEN s_suppkey % 2 = 0 THEN 'isoform' ELSE 'class' END) FROM supplier GROUP BY 1, 2),
p(start, node, path, kinds) AS (SELECT a, b, [a, b], [kind] FROM e WHERE a IN ('0', '1', '2', '3') AND a <> b
  UNION ALL SELECT start, e.b, list_append(path, e.b), list_append(kinds, e.kind) FROM p JOIN e ON p.node = e.a WHERE NOT list_contains(path, e.b) AND len(path) <= 3)
SELECT start, node, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path, array_to_string(kinds, '>') AS kinds FROM p QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY len(path), path, kinds) = 1""")
def typed_paths(spark, d):
    """Nodes within three hops of four nations over edges of two kinds, which have cycles."""
    s, n = table(spark, d, "supplier"), F.col("s_nationkey")
    edges = s.select(n.alias("a"), ((n * 7 + F.col("s_suppkey")) % 25).alias("b"), F.when(F.col("s_suppkey") % 2 == 0, "isoform").otherwise("class").alias("kind"))
    found = governance.shortest_paths(edges, "a", "b", "kind", table(spark, d, "nation").where("n_nationkey < 4").select("n_nationkey"), hops=3)
    return found.select("start", "node", "hops", F.array_join("path", ">").alias("path"), F.array_join("kinds", ">").alias("kinds"))


_WEIGHED = "0.25 * (l_linenumber % 5) / 4.0 + 0.20 * (l_partkey % 10) / 9.0 + 0.15 * (l_quantity / 50) + 0.15 * (CASE WHEN l_suppkey % 2 = 0 THEN 0.5 ELSE 1.0 END) + 0.15 * l_discount * 10 + 0.10 * l_tax * 12"


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, round({_WEIGHED}, 6) AS quality_score FROM lineitem")
def weighted_quality(spark, d):
    """The composite of six components, each a share."""
    c = F.col
    parts = {
        "curation": (c("l_linenumber") % 5) / 4, "assay_confidence": (c("l_partkey") % 10) / 9, "replication": c("l_quantity") / 50,
        "concordance": F.when(c("l_suppkey") % 2 == 0, 0.5).otherwise(1.0), "guideline": c("l_discount") * 10, "provenance": c("l_tax") * 12,
    }
    return table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.round(scalars.composite_quality(parts), 6).alias("quality_score"))
