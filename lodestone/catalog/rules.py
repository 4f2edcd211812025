"""Rule tables, unit checks, constraints, governance, scalar functions, request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.catalog.data import TIER, rounded, tiered
from lodestone.functions import scalars
from lodestone.operators import constraints, drift, governance, likeness, units
from lodestone.plans import flows
from lodestone.session import table
from lodestone.streaming import monitors

_D = """d AS (SELECT p_partkey, p_retailprice / 3 AS mw, p_size / 7.0 - 1 AS logp, p_size * 3.5 AS tpsa, p_size * 3.0 AS mr, p_size % 9 AS hbd, p_size % 13 AS hba,
  p_size % 17 AS rotb, p_size + 5 AS heavy_atoms, p_size % 10 AS ring_count, p_size % 6 AS heteroatoms, p_size % 12 AS carbons,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 7.0 END AS logd, p_size % 3 - 1 AS charge FROM part)"""
_LIP = "((mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT)"


def descriptors(spark, d: str):
    s = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", (F.col("p_retailprice") / 3).alias("mw"), (s / 7.0 - 1).alias("logp"), (s * 3.5).alias("tpsa"), (s * 3.0).alias("mr"),
        (s % 9).alias("hbd"), (s % 13).alias("hba"), (s % 17).alias("rotb"), (s + 5).alias("heavy_atoms"), (s % 10).alias("ring_count"),
        (s % 6).alias("heteroatoms"), (s % 12).alias("carbons"), F.when(s % 4 != 0, s / 7.0).alias("logd"), (s % 3 - 1).alias("charge"),
    )


@query(f"""WITH {_D} SELECT p_partkey, {_LIP} AS lipinski_violations, {_LIP} <= 1 AS lipinski_pass, rotb <= 10 AND tpsa <= 140 AS veber_pass,
  mw BETWEEN 160 AND 480 AND logp BETWEEN -0.4 AND 5.6 AND mr BETWEEN 40 AND 130 AND heavy_atoms BETWEEN 20 AND 70 AS ghose_pass, tpsa <= 131.6 AND logp <= 5.88 AS egan_pass,
  mw BETWEEN 200 AND 600 AND logp BETWEEN -2 AND 5 AND tpsa <= 150 AND ring_count <= 7 AND carbons > 4 AND heteroatoms > 1 AND rotb <= 15 AND hbd <= 5 AND hba <= 10 AS muegge_pass,
  mw < 300 AND logp <= 3 AND hbd <= 3 AND hba <= 3 AND rotb <= 3 AS ro3_pass, CASE WHEN logd IS NOT NULL THEN logp > 3 AND tpsa < 75 END AS pfizer_3_75_flag, logp > 4 AND mw > 400 AS gsk_4_400_flag FROM d""")
def drug_likeness_rules(spark, d):
    df = descriptors(spark, d)
    return df.select("p_partkey", *[c.alias(n) for n, c in likeness.rules({c: F.col(c) for c in df.columns}).items()])


@query(f"WITH {_D} SELECT p_partkey, (CASE WHEN charge < 0 THEN CASE WHEN tpsa <= 75 THEN 0.85 WHEN tpsa < 150 THEN 0.56 ELSE 0.11 END WHEN {_LIP} <= 1 THEN 0.55 ELSE 0.17 END)::DOUBLE AS score FROM d")
def bioavailability(spark, d):
    passed = likeness.lipinski_violations(*[F.col(c) for c in ("mw", "logp", "hbd", "hba")]) <= 1
    return descriptors(spark, d).select("p_partkey", likeness.bioavailability(F.col("charge"), F.col("tpsa"), passed).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'none' WHEN least(p_size % 3, p_size % 5) = p_size % 5 THEN 'complete' WHEN least(p_size % 3, p_size % 5) = 0 THEN 'undefined' ELSE 'partial' END AS stereo FROM part")
def stereo_class(spark, d):
    n = F.col("p_size") % 5
    return table(spark, d, "part").select("p_partkey", likeness.stereo_class(n, F.least(F.col("p_size") % 3, n)).alias("stereo"))


@query("SELECT p_partkey, CASE WHEN n = 1 THEN 'single' WHEN n - s = 1 THEN 'parent_with_salt' WHEN n - s = 0 THEN 'salt_only' ELSE 'mixture' END AS fragments FROM (SELECT p_partkey, p_size % 4 + 1 AS n, least(p_size % 3, p_size % 4 + 1) AS s FROM part)")
def fragment_class(spark, d):
    n = F.col("p_size") % 4 + 1
    return table(spark, d, "part").select("p_partkey", likeness.fragment_class(n, F.least(F.col("p_size") % 3, n)).alias("fragments"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg((c_acctbal < 0 OR c_acctbal > 9500)::INT), 6) AS outside, avg((c_acctbal < 0 OR c_acctbal > 9500)::INT) <= 0.15 AS passed FROM customer GROUP BY 1")
def unit_range(spark, d):
    return rounded(units.verify_range(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", F.lit(0), F.lit(9500), 0.15), "outside")


@query("""WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1),
g AS (SELECT e.event_type, any_value(n) AS n, avg(pow((value - m) / sd, 3)) AS g FROM events e JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, n, round(g, 5) AS skewness, abs(g) <= 2 AS passed, FALSE AS error FROM g""")
def unit_skewness(spark, d):
    return rounded(units.verify_skewness(table(spark, d, "events"), ["event_type"], "value"), "skewness", digits=5)


_GAPS = "g AS (SELECT s_name, s_acctbal, CASE WHEN s_acctbal > 0 THEN abs(log10(s_acctbal) - log10(5000)) ELSE abs(s_acctbal - 5000) END AS gap FROM supplier)"


@query(f"""WITH {_GAPS}, t AS (SELECT count(*) AS n, bool_and(gap <= 1) AS passed, count(*) FILTER (gap > 1) AS failures FROM g),
f AS (SELECT s_name, 5000::DOUBLE AS expected, s_acctbal AS observed, round(gap, 6) AS gap FROM g WHERE gap > 1)
SELECT t.*, f.* FROM t LEFT JOIN f ON TRUE""")
def unit_reference(spark, d):
    """The verdict, and in a row each the references that it rests on."""
    return rounded(units.reference_report(table(spark, d, "supplier").withColumn("expected", F.lit(5000.0)), "s_name", "expected", "s_acctbal"), "gap")


@query(f"WITH {_GAPS} SELECT s_name, 5000::DOUBLE AS expected, s_acctbal AS observed, round(gap, 6) AS gap FROM g WHERE gap > 1")
def unit_reference_failures(spark, d):
    return rounded(units.failed_references(table(spark, d, "supplier").withColumn("expected", F.lit(5000.0)), "s_name", "expected", "s_acctbal"), "gap")


@query(f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, {TIER} AS tier, * FROM lineitem)
SELECT 'black_is_not_commercial' AS rule, id::VARCHAR AS key FROM l WHERE NOT ((tier = 'black') = NOT (l_linenumber < 5))
UNION ALL SELECT 'interval_holds_value', id::VARCHAR FROM l WHERE NOT (l_discount <= l_tax AND l_tax <= 0.07)
UNION ALL SELECT 'imported_within_parsed', id::VARCHAR FROM l WHERE NOT (l_quantity <= 48)""")
def constraint_violations(spark, d):
    df = tiered(spark, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rules = {
        "black_is_not_commercial": constraints.tier_rules(F.col("tier"), F.col("l_linenumber") < 5, F.lit(False))["black_is_not_commercial"],
        "interval_holds_value": constraints.prediction_rules(F.col("l_discount"), F.col("l_tax"), F.lit(0.07))["interval_holds_value"],
        "imported_within_parsed": constraints.run_rules(F.lit(1), F.lit(1), F.lit(True), F.lit(48), F.col("l_quantity"))["imported_within_parsed"],
    }
    return constraints.violations(df, "id", rules)


@query("SELECT 'orders_customer' AS rule, o_custkey::VARCHAR AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)")
def fk_orphans(spark, d):
    parents = table(spark, d, "customer").where("c_custkey % 11 <> 0")
    return constraints.orphans(table(spark, d, "orders"), parents, "o_custkey", "c_custkey", "orders_customer")


@query("""SELECT 'one_group_per_key' AS rule, p_brand AS key FROM part GROUP BY p_brand HAVING count(DISTINCT p_size % 2) > 1
UNION ALL SELECT 'unique_name', p_name FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'all_principles', p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_size % 40) FILTER (p_size % 40 IN (1, 2, 3, 4, 5)) < 5""")
def group_constraints(spark, d):
    parts = table(spark, d, "part").withColumn("g", F.col("p_size") % 2).withColumn("m", (F.col("p_size") % 40).cast("string"))
    return constraints.all_violations(
        constraints.several_groups(parts, "p_brand", "g", "one_group_per_key"), constraints.repeated(parts, ["p_name"], "unique_name"),
        constraints.missing_members(parts, "p_brand", "m", ["1", "2", "3", "4", "5"], "all_principles"),
    )


@query("SELECT count(*) AS violations, count(*) = 0 AS passed FROM orders WHERE NOT (o_totalprice >= 0)")
def constraint_gate(spark, d):
    return constraints.gate(constraints.violations(table(spark, d, "orders"), "o_orderkey", {"price_not_negative": F.col("o_totalprice") >= 0}))


@query("""SELECT CASE WHEN c_custkey IS NULL THEN 'unknown_model_version' ELSE 'feature_set_mismatch' END AS rule, o_orderkey::VARCHAR AS key
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey WHERE CASE o_orderpriority WHEN '1-URGENT' THEN 'BUILDING' ELSE 'MACHINERY' END IS DISTINCT FROM c_mktsegment""")
def feature_set_mismatch(spark, d):
    made = table(spark, d, "orders").select(F.col("o_custkey").alias("version"), "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").otherwise("MACHINERY").alias("fs"))
    versions = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("version"), F.col("c_mktsegment").alias("fs"))
    return constraints.feature_set_mismatches(made, versions, "version", "fs", "o_orderkey")


@query("""WITH m AS (SELECT c_custkey AS k, CASE n_regionkey % 3 WHEN 0 THEN 'expert_rule_based' WHEN 1 THEN 'statistical_based' ELSE 'other' END AS m FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey, o_custkey AS x, o_orderkey % 100 + 1 AS y FROM orders), j AS (SELECT o.*, a.m AS m1, b.m AS m2 FROM o LEFT JOIN m a ON a.k = x LEFT JOIN m b ON b.k = y)
SELECT 'distinct_predictions' AS rule, o_orderkey::VARCHAR AS key FROM j WHERE x = y
UNION ALL SELECT 'rule_based_methodology', o_orderkey::VARCHAR FROM j WHERE m1 IS DISTINCT FROM 'expert_rule_based'
UNION ALL SELECT 'statistical_methodology', o_orderkey::VARCHAR FROM j WHERE m2 IS DISTINCT FROM 'statistical_based'
UNION ALL SELECT 'review_when_required', o_orderkey::VARCHAR FROM j WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 0
UNION ALL SELECT 'conclusion_requires_class', o_orderkey::VARCHAR FROM j WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 = 0""")
def methodology_pairing(spark, d):
    k, at = F.col("o_orderkey"), F.col("n_regionkey") % 3
    m = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("prediction"), F.when(at == 0, constraints.RULE_BASED).when(at == 1, constraints.STATISTICAL).otherwise("other").alias("methodology")
    )
    a = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("rule_based"), (k % 100 + 1).alias("statistical"), (k % 3 == 0).alias("needs_review"), F.when(k % 5 != 0, k).alias("review"),
        F.when(k % 2 == 0, "no concern").alias("conclusion"), F.when(k % 7 != 0, "class 5").alias("class"),
    )
    return constraints.methodology_pairs(a, m, "rule_based", "statistical", "o_orderkey", "review", "needs_review", "conclusion", "class")


@query("SELECT count(*) AS n, bool_and(n_nationkey <> 3) AS unchanged FROM nation")
def same_definition(spark, d):
    a = table(spark, d, "nation")
    b = a.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name")))
    return constraints.same_definition(b, a, "n_nationkey", ["n_name", "n_regionkey"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def owned_rows(spark, d):
    s = table(spark, d, "supplier").withColumn("owner", F.sha2(F.col("s_nationkey").cast("string"), 256))
    return constraints.visible_to(s, "owner", "7").select("s_suppkey", "s_name")


@query("SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS h FROM nation")
def record_hash(spark, d):
    return table(spark, d, "nation").select("n_nationkey", constraints.record_hash(F.col("n_nationkey"), F.col("n_name")).alias("h"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'insert' WHEN n_nationkey % 5 = 1 THEN 'license_change' WHEN n_nationkey % 5 = 2 THEN 'update' ELSE 'unchanged' END AS action,
CASE WHEN n_nationkey % 5 = 2 THEN 'n_name' ELSE '' END AS changed FROM nation""")
def registry_diff(spark, d):
    a = table(spark, d, "nation")
    k = F.col("n_nationkey") % 5
    b = a.where(k != 0).withColumn("n_regionkey", F.when(k == 1, F.lit(None)).otherwise(F.col("n_regionkey"))).withColumn("n_name", F.when(k.isin(1, 2), "old").otherwise(F.col("n_name")))
    return governance.registry_diff(a, b, "n_nationkey", ["n_regionkey"], ["n_name"])


_KINDS = ("source", "portion", "default", "exclusion", "excluded", "source", "source")
_SPDX = (None, "CC0-1.0", "US-PD", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-NC-4.0", "UNKNOWN", "MIXED", "GPL-3.0", "PDDL-1.0", "PROPRIETARY")
_TIER = ("green", "amber", "red", "black", "mixed", None, "teal")


def _pick(values: tuple, k: str) -> str:
    return "(CASE " + " ".join(f"WHEN {k} % {len(values)} = {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END)"


#: In both dialects: licence blocks of all kinds, made of the rows of orders.
_BLOCKS = f"""SELECT o_orderkey AS source_id, 'b' AS context, {_pick(_KINDS, "o_custkey")} AS kind, o_custkey % 11 > 0 AS licensed, {_pick(_SPDX, "o_orderkey")} AS spdx,
  {_pick(_TIER, "(o_orderkey + o_custkey)")} AS tier, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 = 1 END AS commercial_ok, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 = 1 END AS sharealike,
  CASE WHEN o_custkey % 5 > 0 THEN concat('clerk', o_custkey) END AS attribution, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS portions, CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END AS exclusions,
  o_custkey % 13 = 0 AS stale, o_custkey % 17 = 0 AS unverified, CASE WHEN o_custkey % 2 = 0 THEN 'r' END AS reason FROM orders"""


def licenses(spark, d: str):
    return spark.sql(_BLOCKS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


_TIER_SQL = "CASE " + " ".join(f"WHEN spdx = '{k}' THEN '{v}'" for k, v in governance.LICENSE_TIERS.items()) + " END"


@query(f"""WITH l AS ({_BLOCKS}), e AS (SELECT *, {_TIER_SQL} AS want, kind IN ('source', 'portion', 'default') AND licensed AS a,
  coalesce(tier IN ('green', 'amber', 'red', 'mixed', 'black'), FALSE) AS ok FROM l), m AS (SELECT *, a AND spdx IS NOT NULL AND ok AND spdx <> 'MIXED' AND want IS NOT NULL AS mapped FROM e)
SELECT source_id, context, 'LC-01' AS rule, 'no_license' AS finding, 'error' AS severity FROM m WHERE kind = 'source' AND NOT licensed
UNION ALL SELECT source_id, context, 'LC-01', 'missing_identifier', 'error' FROM m WHERE a AND spdx IS NULL
UNION ALL SELECT source_id, context, 'LC-01', 'invalid_tier', 'error' FROM m WHERE a AND spdx IS NOT NULL AND NOT ok
UNION ALL SELECT source_id, context, 'LC-02', 'unknown_identifier', 'error' FROM m WHERE a AND ok AND spdx = 'GPL-3.0'
UNION ALL SELECT source_id, context, 'LC-02', 'tier_contradicts_identifier', 'error' FROM m WHERE mapped AND want <> tier
UNION ALL SELECT source_id, context, 'LC-03', 'commercial_flag_contradicts_tier', 'error' FROM m WHERE mapped AND commercial_ok = (want = 'black')
UNION ALL SELECT source_id, context, 'LC-02', 'sharealike_contradicts_identifier', 'error' FROM m WHERE mapped AND sharealike = (want <> 'red')
UNION ALL SELECT source_id, context, 'LC-05', 'attribution_missing', 'error' FROM m WHERE mapped AND want IN ('amber', 'red') AND attribution IS NULL
UNION ALL SELECT source_id, context, 'LC-01', 'mixed_without_portions', 'error' FROM m WHERE kind = 'source' AND licensed AND spdx = 'MIXED' AND portions = 0 AND exclusions = 0
UNION ALL SELECT source_id, context, 'LC-03', 'exclusion_not_black', 'error' FROM m WHERE kind = 'exclusion' AND tier IS DISTINCT FROM 'black'
UNION ALL SELECT source_id, context, 'LC-03', 'exclusion_commercial', 'error' FROM m WHERE kind = 'exclusion' AND commercial_ok IS DISTINCT FROM FALSE
UNION ALL SELECT source_id, context, 'LC-04', 'stale', 'warning' FROM m WHERE kind = 'source' AND licensed AND stale
UNION ALL SELECT source_id, context, 'figures', 'unverified', 'warning' FROM m WHERE kind = 'source' AND licensed AND unverified
UNION ALL SELECT source_id, context, 'LC-06', 'excluded_is_commercial', 'error' FROM m WHERE kind = 'excluded' AND commercial_ok AND tier IS DISTINCT FROM 'red'
UNION ALL SELECT source_id, context, 'LC-06', 'excluded_without_reason', 'error' FROM m WHERE kind = 'excluded' AND reason IS NULL""")
def license_audit(spark, d):
    return governance.license_audit(licenses(spark, d))


_SOURCES = """SELECT s_suppkey AS source_id, s_name AS name, CASE s_suppkey % 6 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' WHEN 2 THEN 'red' WHEN 3 THEN 'mixed' WHEN 4 THEN 'black' END AS tier,
  CASE WHEN s_suppkey % 4 > 0 THEN 'CC-BY-4.0' END AS spdx, CASE WHEN s_suppkey % 5 > 0 THEN 'by ' || s_name END AS attribution FROM {supplier}"""
_RANK = "(CASE tier WHEN 'green' THEN 1 WHEN 'amber' THEN 2 WHEN 'red' THEN 3 WHEN 'mixed' THEN 4 WHEN 'black' THEN 5 ELSE 0 END)::BIGINT"


@query(f"WITH l AS ({_SOURCES.format(supplier='supplier')}) SELECT tier, CASE WHEN tier IS NULL THEN NULL ELSE {_RANK} END AS rank, string_agg(lpad(source_id::VARCHAR, 6, '0'), ',' ORDER BY source_id) AS sources FROM l GROUP BY tier")
def attribution_manifest(spark, d):
    sources = spark.sql(_SOURCES, supplier=table(spark, d, "supplier"))
    return governance.attribution_manifest(sources.withColumn("source_id", F.lpad(F.col("source_id").cast("string"), 6, "0")))


@query(f"""WITH l AS ({_SOURCES.format(supplier='supplier')}), r AS (SELECT {_RANK} AS tier_rank, tier, name, '- **' || name || '** \u2014 ' || coalesce(spdx, 'None') || coalesce(chr(10) || '  > ' || attribution, '') AS line FROM l WHERE tier IS NOT NULL)
SELECT tier_rank, 1 AS rank, name, line FROM r UNION ALL SELECT DISTINCT tier_rank, 0, '', '## Tier: ' || tier FROM r UNION ALL SELECT 0, 0, '', '# Attributions'""")
def attribution_lines(spark, d):
    return governance.attribution_lines(spark.sql(_SOURCES, supplier=table(spark, d, "supplier")), "name", "Attributions")


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'soft_delete' WHEN 2 THEN 'restore' ELSE 'update' END AS operation FROM supplier WHERE s_suppkey % 5 < 4""")
def audit_changes(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey") % 5
    before = s.where(k != 0).withColumn("gone", k == 2)
    after = s.withColumn("gone", k == 1).withColumn("s_name", F.when(k == 3, "new").otherwise(F.col("s_name")))
    return governance.audit_rows(before, after, "s_suppkey", ["s_name", "s_acctbal"], "gone", "system", "test").select("s_suppkey", "operation")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey) GROUP BY o_custkey")
def latest_run_state(spark, d):
    return governance.latest_state(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))")
def insert_if_absent(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return governance.insert_absent(table(spark, d, "customer").where("c_custkey % 2 = 0"), rows, ["c_custkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)
SELECT p AS ancestor, c AS descendant, 1 AS depth FROM e UNION ALL SELECT a.p, b.c, 2 FROM e a JOIN e b ON a.c = b.p""")
def ontology_closure(spark, d):
    a = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("c"))
    b = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("p"), F.concat(F.lit("c"), "c_custkey").alias("c"))
    return governance.closure(a.unionByName(b), "p", "c")


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 40 AS g, p_partkey % 40 AS i FROM part WHERE p_partkey % 40 > 0),
u(a, d, n) AS (SELECT g || '.' || (i - 1), g || '.' || i, 1 FROM e UNION ALL SELECT e.g || '.' || (e.i - 1), u.d, u.n + 1 FROM u JOIN e ON u.a = e.g || '.' || e.i)
SELECT a AS ancestor, d AS descendant, n AS depth FROM u""")
def chain_closure(spark, d):
    """Chains of 39 edges."""
    k = F.col("p_partkey")
    name = lambda i: F.concat_ws(".", F.floor(k / 40).cast("string"), i.cast("string"))
    edges = table(spark, d, "part").where(k % 40 > 0).select(name(k % 40 - 1).alias("p"), name(k % 40).alias("c"))
    return governance.closure(edges, "p", "c")


@query("""SELECT doc_id, 'v' || doc_id % 3 || '__2024-01-02__' || substr(sha256(source), 1, 12) AS snapshot,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'green/' || source || '/s' || doc_id || '/f.csv' END AS landing FROM documents""")
def snapshot_ids(spark, d):
    day = F.to_date(F.lit("2024-01-02"))
    bad = F.when(F.col("doc_id") % 10 == 0, "a/b").otherwise(F.col("source"))
    return table(spark, d, "documents").select(
        "doc_id", scalars.snapshot_id(F.concat(F.lit("v"), F.col("doc_id") % 3), day, F.sha2("source", 256)).alias("snapshot"),
        scalars.landing_key(F.lit("green"), bad, F.concat(F.lit("s"), "doc_id"), F.lit("f.csv")).alias("landing"),
    )


@query("SELECT p_brand, sha256('1.0||chem-1||' || string_agg(DISTINCT p_type, '||' ORDER BY p_type)) AS fs FROM part GROUP BY 1")
def feature_set_id(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("names"))
    return g.select("p_brand", scalars.feature_set_id(F.lit("1.0"), F.lit("chem-1"), F.col("names")).alias("fs"))


_LOOKS = r"""(length({w}) BETWEEN 6 AND 5000 AND regexp_full_match({w}, '[A-Za-z0-9@+\-\[\]()=#$:/\\.%]+') AND NOT contains({w}, ':') AND NOT regexp_full_match({w}, '[0-9a-f]{{12,}}')
  AND NOT regexp_full_match({w}, '[0-9A-HJKMNP-TV-Z]{{26}}') AND length({w}) - length(replace({w}, '/', '')) <= 1 AND length({w}) - length(replace({w}, '\', '')) <= 1
  AND length(regexp_replace({w}, '[^A-Za-z]', '', 'g')) >= 3
  AND regexp_matches({w}, '\[[A-Za-z][A-Za-z0-9@+\-]{{0,8}}\]|[bcnops]{{2,}}[0-9]|[0-9][bcnops]{{2,}}|[A-Z][=#][A-Za-z(\[]|\)[=#]?[A-Z]|\([=#][A-Z]'))"""
_BODY = r"""regexp_replace(w, '[.,;:!?"'']+$', '')"""
_SPACE = r"\s\v\x{85}\p{Z}"
_SAFE = rf"""array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace({{t}}, 'InChI=1S?/[^\s"'']+', '[REDACTED:structure]', 'g'), '\b[A-Z]{{{{14}}}}-[A-Z]{{{{10}}}}-[A-Z]\b', '[REDACTED:structure]', 'g'),
  '[^{_SPACE.replace("{", "{{").replace("}", "}}")}]+|[{_SPACE.replace("{", "{{").replace("}", "}}")}]+'), lambda w: CASE WHEN {_LOOKS.format(w="w").replace("{", "{{").replace("}", "}}")} THEN '[REDACTED:structure sha256:' || substr(sha256(w), 1, 12) || ']'
  WHEN {_LOOKS.format(w=_BODY).replace("{", "{{").replace("}", "}}")} THEN '[REDACTED:structure sha256:' || substr(sha256({_BODY}), 1, 12) || ']' || substr(w, length({_BODY}) + 1) ELSE w END), '')"""
#: In both dialects: sentences with structures, keys and things that only look like structures.
_SENTENCE = """concat(p_name, ' CC(=O)Nc1ccc', p_size, 'cc1, C', p_partkey % 7, '=C(C)C. InChI=1S/CH', p_size, '/h1 (c1ccccc', p_partkey % 9, '). ABCDEFGHIJKLMN-OPQRSTUVWX-Y a/b/c=O/', p_size, ' ',
  md5(p_name), ' t:C=OCC ', p_type)"""


@query(f"SELECT p_partkey, {_SAFE.format(t=_SENTENCE)} AS safe FROM part")
def redact_text(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.redact(F.expr(_SENTENCE)).alias("safe"))


@query(f"SELECT doc_id, {_SAFE.format(t='text')} AS safe FROM documents")
def redact_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.redact(F.col("text")).alias("safe"))


@query("""SELECT p_partkey, '[REDACTED:structure sha256:' || substr(sha256(p_name), 1, 12) || ']' AS smiles, '[REDACTED:structure]' AS mol, p_brand AS brand,
  '[REDACTED:structure sha256:' || substr(sha256(p_type), 1, 12) || ']' AS inner_inchi, p_size AS inner_size, p_brand || ',' || p_size AS tags FROM part""")
def redact_events(spark, d):
    events = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("smiles"), F.struct(F.col("p_name")).alias("mol"), F.col("p_brand").alias("brand"),
        F.struct(F.col("p_type").alias("InChI"), F.col("p_size").alias("size")).alias("inner"), F.array("p_brand", F.col("p_size").cast("string")).alias("tags"),
    )
    safe = scalars.redacted_events(events)
    return safe.select("p_partkey", "smiles", "mol", "brand", F.col("inner.InChI").alias("inner_inchi"), F.col("inner.size").alias("inner_size"), F.array_join("tags", ",").alias("tags"))


#: In both dialects: identifiers made of the order's keys; the alphabet's letters give the time.
_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_ULID = "'01' || " + " || ".join(f"substr('{_ALPHABET}', 1 + ((o_orderkey * {7 + i} + o_custkey * {3 * i + 1}) % 32)::INT, 1)" for i in range(24))
_MILLIS = " + ".join(f"(instr('{_ALPHABET}', substr(u, {i}, 1)) - 1)::BIGINT * {32 ** (10 - i)}" for i in range(1, 11))


@query(f"""WITH o AS (SELECT *, {_ULID} AS u FROM orders)
SELECT o_orderkey, {_MILLIS} AS millis, lower(o_orderstatus) || 'x_' || u AS public, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE lower(o_orderstatus) || 'x' END AS prefix,
  left(upper(md5(o_orderkey::VARCHAR)), 14) AS skeleton, 'C' || o_custkey || 'H' || o_orderkey % 9 AS formula FROM o""")
def identifiers(spark, d):
    ulid = F.expr(_ULID.replace("::INT", ""))
    orders = table(spark, d, "orders").withColumn("u", ulid)
    public = scalars.public_id(F.concat(F.lower("o_orderstatus"), F.lit("x")), F.col("u"))
    broken = F.when(F.col("o_custkey") % 3 == 0, F.concat(public, F.lit("U"))).otherwise(public)
    formula = F.concat(F.lit("C"), "o_custkey", F.lit("H"), F.col("o_orderkey") % 9)
    charge = F.when(F.col("o_custkey") % 4 == 0, "+").when(F.col("o_custkey") % 4 == 1, "-2").otherwise("")
    return orders.select(
        "o_orderkey", scalars.ulid_millis(F.col("u")).alias("millis"), public.alias("public"), scalars.parse_public_id(broken)["prefix"].alias("prefix"),
        scalars.skeleton(F.upper(F.md5(F.col("o_orderkey").cast("string")))).alias("skeleton"), scalars.without_charge(F.concat(formula, charge)).alias("formula"),
    )


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'EMPTY_INPUT' WHEN length(text) > 5000 THEN 'INPUT_TOO_LONG' WHEN contains(text, '*') THEN 'WILDCARD_ATOM'
  WHEN lang = 'fr' THEN 'MIXTURE' WHEN n_chars < 100 THEN 'NO_DESCRIPTORS' WHEN n_chars > 2000 THEN 'TOO_HEAVY' END AS reason FROM documents""")
def input_acceptance(spark, d):
    reason = scalars.rejection_reason(F.col("text"), F.col("lang") == "fr", F.col("n_chars") >= 100, F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


_PARADIGM = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {w!r})' for w in words)} THEN '{name}'" for name, words in scalars.PARADIGMS) + " ELSE 'other_unclassified' END"


@query(f"SELECT doc_id, {_PARADIGM} AS paradigm FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def paradigm_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.first_category(F.col("text")).alias("paradigm"))


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice::DECIMAL(18,6) * 0.001)::DOUBLE AS canonical FROM lineitem")
def unit_conversion_lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.canonical_value(F.col("l_extendedprice"), F.lit("0.001")).cast("double").alias("canonical"))


@query("SELECT p_partkey, round(greatest(0.6931471805599453 * p_size / 5 / 3, 3 / (0.6931471805599453 * p_size / 5)), 6) AS fold, round((p_size / 50.0 * 0.6 + 0.5 * 0.4), 6) AS score FROM part")
def consistency_scores(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.round(scalars.half_life_fold(F.lit(5.0), F.col("p_size"), F.lit(3.0)), 6).alias("fold"),
        F.round(scalars.quality_score({"a": (F.col("p_size") / 50.0, 0.6), "b": (F.lit(0.5), 0.4), "c": (F.lit(None).cast("double"), 0.0)}), 6).alias("score"),
    )


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def request_rate(spark, d):
    return monitors.sliding_count(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "n_recent")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, d):
    out = monitors.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY ALL")
def rejection_rates(spark, d):
    out = monitors.outcome_rates(table(spark, d, "events"), "ts", "1 hour", F.col("event_type") == "error")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "rejected")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    out = monitors.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query()
def rate_limit(spark, d):
    return monitors.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", limit=2, period=86_400)


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_property(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""WITH a AS (SELECT l_quantity AS v, count(*) FILTER (l_orderkey % 2 = 0) AS a, count(*) FILTER (l_orderkey % 2 = 1 AND l_linenumber < 4) AS b FROM lineitem GROUP BY 1),
c AS (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d FROM a WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(d), 6) AS ks FROM c""")
def drift_distance(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(drift.kolmogorov_smirnov(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1 and l_linenumber < 4"), "l_quantity"), "ks")


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS release, count(*) AS n, round(avg((n_chars IS NULL)::INT), 6) AS null_rate, round(avg((lang = 'en')::INT), 6) AS positive_rate
FROM documents GROUP BY 1""")
def drift_summary(spark, d):
    docs = table(spark, d, "documents").withColumn("y", (F.col("lang") == "en").cast("int"))
    return rounded(drift.release_summary(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "n_chars", "y"), "null_rate", "positive_rate")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <> 2")
def endpoint_view(spark, d):
    rows = table(spark, d, "lineitem").withColumn("gone", F.col("l_linenumber") == 2)
    kinds = spark.createDataFrame([("R", "returned"), ("A", "accepted"), ("N", "none")], "l_returnflag string, kind string")
    flows.endpoint_views(rows.where("l_linestatus = 'F'"), kinds, {"returned_lines": "returned", "accepted_lines": "accepted"}, "l_returnflag", "kind", "gone")
    return spark.table("returned_lines").select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n FROM events WHERE event_type <> 'view' AND event_id % 3 = 0 AND user_id % 10 = 8 AND event_id % 7 <> 0")
def cross_species_anomalies(spark, d):
    e = table(spark, d, "events")
    cell = F.when(F.col("event_id") % 3 != 0, "cell")
    hit = flows.cross_species(F.col("event_type"), cell, F.col("user_id") % 10, F.col("event_id") % 7 == 0, "view")
    return e.where(hit).agg(F.count(F.lit(1)).alias("n"))
