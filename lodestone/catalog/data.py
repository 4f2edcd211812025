"""Aggregation, duplicates, resolution, splits, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import aggregate as agg
from lodestone.operators import dedup, profile, split
from lodestone.plans import flows
from lodestone.session import table

TIER = "CASE l_suppkey % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' WHEN 2 THEN 'red' ELSE 'black' END"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def tiered(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("tier", F.expr(TIER))


_POTENCY = """
  SELECT l_partkey, l_returnflag, n,
         round(CASE WHEN n = 1 THEN lo ELSE pow(10, lg) END, 6) AS value,
         CASE WHEN n = 1 THEN 'single_value' ELSE 'geometric_mean' END AS method,
         round(CASE WHEN n = 1 THEN 0.0 ELSE log10(hi / lo) END, 6) AS spread,
         n > 1 AND log10(hi / lo) > {t} AS discordant, FALSE AS error
  FROM (SELECT l_partkey, l_returnflag, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
               avg(log10(l_extendedprice)) AS lg FROM lineitem {w} GROUP BY ALL)"""


@query(_POTENCY.format(t="1", w=""))
def agg_continuous_potency(spark, d):
    return rounded(agg.aggregate_continuous(table(spark, d, "lineitem"), ["l_partkey", "l_returnflag"], "l_extendedprice"), "value", "spread")


@query("""
SELECT c_nationkey, c_mktsegment, n, round(CASE WHEN n = 1 THEN lo ELSE md END, 6) AS value,
       CASE WHEN n = 1 THEN 'single_value' ELSE 'median' END AS method,
       round(CASE WHEN n = 1 THEN 0.0 WHEN lo > 0 THEN log10(hi / lo) ELSE hi - lo END, 6) AS spread,
       n > 1 AND (CASE WHEN lo > 0 THEN log10(hi / lo) ELSE hi - lo END) > 1 AS discordant, FALSE AS error
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, median(c_acctbal) AS md
      FROM customer GROUP BY ALL)""")
def agg_continuous_median_signed(spark, d):
    return rounded(agg.aggregate_continuous(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", potency=False), "value", "spread")


@query("""
SELECT l_partkey, n, n_true, CASE WHEN 2 * n_true = n THEN 0.5 WHEN 2 * n_true > n THEN 1.0 ELSE 0.0 END::DOUBLE AS value,
       CASE WHEN n = 1 THEN 'single_value' ELSE 'majority_vote' END AS method, 2 * n_true = n AS discordant
FROM (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_true FROM lineitem GROUP BY ALL)""")
def agg_binary_vote(spark, d):
    return agg.aggregate_binary(table(spark, d, "lineitem").withColumn("y", F.col("l_linestatus") == "F"), ["l_partkey"], "y")


@query("""
SELECT l_partkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS l_returnflag_set, count(DISTINCT l_returnflag)::INT AS n_l_returnflag,
       string_agg(DISTINCT l_linestatus, ';' ORDER BY l_linestatus) AS l_linestatus_set, count(DISTINCT l_linestatus)::INT AS n_l_linestatus
FROM lineitem GROUP BY ALL""")
def agg_carried_sets(spark, d):
    return agg.carried_sets(table(spark, d, "lineitem"), ["l_partkey"], ["l_returnflag", "l_linestatus"])


@query(f"""
SELECT l_partkey, max(struct_pack(a := l_discount, b := l_extendedprice)).b AS max_confidence,
       max(struct_pack(a := l_shipdate, b := l_extendedprice)).b AS most_recent,
       string_agg(DISTINCT {TIER}, ',' ORDER BY {TIER}) AS license_tiers_consumed, 'v1' AS policy_version
FROM lineitem GROUP BY ALL""")
def agg_by_policy(spark, d):
    return agg.aggregate_by_policy(tiered(spark, d), ["l_partkey"], "l_extendedprice", "l_discount", "l_shipdate", "tier", "v1")


_SPLIT = """list_sum(list_transform(range(1, 65), lambda i: (CASE WHEN i = 64 THEN 1 ELSE 6 END)
  * (instr('0123456789abcdef', substr(sha256({k} || '||s1'), i, 1)) - 1)))::INT % 10"""


@query(f"""
WITH g AS ({_POTENCY.format(t="1", w="WHERE l_returnflag <> 'N' AND l_extendedprice IS NOT NULL")})
SELECT *, CASE WHEN value <= 30000 THEN 1 ELSE 0 END AS label,
       {_SPLIT.format(k="(l_partkey::VARCHAR || '|' || l_returnflag)")} AS split_group
FROM g WHERE NOT discordant""")
def training_set(spark, d):
    df = flows.training_set(table(spark, d, "lineitem"), F.col("l_returnflag") != "N", ["l_partkey", "l_returnflag"], "l_extendedprice", 30000.0, "s1")
    return rounded(df, "value", "spread")


@query("""
WITH g AS (SELECT l_partkey, l_returnflag, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
           FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT count(*) AS groups, count(*) FILTER (n > 1 AND log10(hi / lo) > 1) AS discordant, 0::BIGINT AS errors,
       count(*) FILTER (n = 1 AND lo <= 0) AS non_positive FROM g""")
def exclusion_report(spark, d):
    return flows.exclusion_report(table(spark, d, "lineitem"), F.col("l_returnflag") != "N", ["l_partkey", "l_returnflag"], "l_extendedprice")


@query("""
WITH t(threshold, lim) AS (VALUES ('1k', 1000.0), ('10k', 10000.0), ('30k', 30000.0), ('60k', 60000.0))
SELECT threshold, count(*) AS n, count(*) FILTER (l_extendedprice <= lim) AS positive,
       count(*) FILTER ((l_extendedprice <= lim) <> (l_extendedprice <= 10000)) AS changed
FROM lineitem, t GROUP BY ALL""")
def threshold_sensitivity(spark, d):
    df = agg.relabel(table(spark, d, "lineitem"), "l_extendedprice", {"1k": 1e3, "10k": 1e4, "30k": 3e4, "60k": 6e4})
    base = agg.label_at(F.col("l_extendedprice"), 1e4)
    return df.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") != base).alias("changed"))


@query("""
SELECT key, count(*) OVER w AS n, min(doc_id) OVER w AS representative, doc_id FROM (SELECT doc_id, sha256(text) AS key FROM documents) WINDOW w AS (PARTITION BY key) QUALIFY count(*) OVER w > 1""")
def compound_duplicates(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), "doc_id", F.col("doc_id").alias("seq"))
    return dedup.duplicate_groups(docs, "key", "doc_id", "seq")


_RECORD = "l_orderkey * 10 + l_linenumber"


@query(f"""
WITH r AS (SELECT *, {_RECORD} AS record, nullif(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END, '') AS reference,
                  l_suppkey % 5 AS t FROM lineitem)
SELECT l_partkey, l_returnflag, reference, count(*) AS n,
       arg_min(record, struct_pack(a := CASE WHEN t = 4 THEN 99 ELSE t END, b := -l_discount, c := record)) AS representative,
       CASE WHEN reference IS NULL THEN 'without_reference' ELSE 'with_reference' END AS criterion
FROM r GROUP BY l_partkey, l_returnflag, reference HAVING count(*) > 1""")
def measurement_duplicates(spark, d):
    tiers = F.element_at(F.array(*map(F.lit, (*dedup.TIERS, "other"))), (F.pmod("l_suppkey", F.lit(5)) + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(
        "*", F.expr(_RECORD).alias("record"), tiers.alias("tier"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus")).alias("ref"),
    )
    return dedup.measurement_duplicates(rows, "l_partkey", "l_returnflag", "ref", "tier", "l_discount", "record", "record")


_RESOLVED = """
WITH c AS (
  SELECT o_custkey AS ent, o_orderstatus AS endpoint, 1 AS precedence, NULL::VARCHAR AS ad, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS score,
         o_orderdate AS as_of, o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0
  UNION ALL
  SELECT o_custkey, l_linestatus, 2, CASE WHEN l_suppkey % 3 = 0 THEN 'out_of_domain' ELSE 'in_domain' END, l_discount, l_shipdate,
         -(l_orderkey * 10 + l_linenumber), l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT ent, endpoint, precedence, id, value FROM c
QUALIFY row_number() OVER (PARTITION BY ent, endpoint ORDER BY precedence, (ad IS NOT DISTINCT FROM 'out_of_domain'), score DESC NULLS LAST, as_of DESC, id) = 1"""


@query(_RESOLVED)
def resolved_property(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    measured = orders.where((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 2 == 0)).select(
        F.col("o_custkey").alias("ent"), F.col("o_orderstatus").alias("endpoint"), F.lit(1).alias("precedence"), F.lit(None).cast("string").alias("ad"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("score"), F.col("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"),
    )
    predicted = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("ent"), F.col("l_linestatus").alias("endpoint"), F.lit(2).alias("precedence"),
        F.when(F.col("l_suppkey") % 3 == 0, "out_of_domain").otherwise("in_domain").alias("ad"),
        F.col("l_discount").alias("score"), F.col("l_shipdate").alias("as_of"), (-F.expr(_RECORD)).alias("id"), F.col("l_extendedprice").alias("value"),
    )
    return dedup.resolve(measured.unionByName(predicted), ["ent", "endpoint"], "precedence", "ad", "score", "as_of", "id").select("ent", "endpoint", "precedence", "id", "value")


@query("""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE value END ASC NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def keep_first(spark, d):
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return dedup.keep_first(table(spark, d, "events"), ["user_id"], v.asc_nulls_last(), F.col("event_id")).select("user_id", "event_id", "value")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3")
def evidence_rank(spark, d):
    return dedup.nearest_rows(table(spark, d, "orders"), ["o_custkey"], 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("""
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 50""")
def history_newest(spark, d):
    out = dedup.newest_of_each(table(spark, d, "events"), "user_id", "ts")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query(f"SELECT p_partkey, p_brand, g AS split_group, CASE WHEN g < 7 THEN 'train' WHEN g = 7 THEN 'calibration' WHEN g = 8 THEN 'validation' ELSE 'test' END AS role FROM (SELECT *, {_SPLIT.format(k='p_brand')} AS g FROM part)")
def split_assign(spark, d):
    g = split.split_group(F.col("p_brand"), "s1")
    return table(spark, d, "part").select("p_partkey", "p_brand", g.alias("split_group")).withColumn("role", split.role(F.col("split_group")))


@query(f"""
WITH b AS (SELECT {_SPLIT.format(k='p_partkey::VARCHAR')} AS g, count(*) AS n, avg((p_size > 25)::INT) AS m FROM part GROUP BY 1)
SELECT round(min(m), 6) AS min_mean, round(max(m), 6) AS max_mean, round(stddev_pop(m), 6) AS sd_mean, sum(n)::BIGINT AS n FROM b""")
def split_balance(spark, d):
    parts = table(spark, d, "part").select(split.split_group(F.col("p_partkey"), "s1").alias("g"), (F.col("p_size") > 25).cast("int").alias("y"))
    return rounded(split.balance_summary(split.split_balance(parts, "g", "y")), "min_mean", "max_mean", "sd_mean")


@query(f"""
SELECT p_brand, count(DISTINCT g) AS n_groups, count(*) AS n FROM (SELECT p_brand, {_SPLIT.format(k='p_partkey::VARCHAR')} AS g FROM part)
GROUP BY p_brand HAVING count(DISTINCT g) > 1""")
def scaffold_leak(spark, d):
    parts = table(spark, d, "part").withColumn("g", split.split_group(F.col("p_partkey"), "s1"))
    return split.spanning_keys(parts, "p_brand", "g")


@query("""
SELECT key, count(DISTINCT doc_id % 10) AS n_groups, count(*) AS n FROM (SELECT sha256(text) AS key, doc_id FROM documents) GROUP BY key HAVING count(DISTINCT doc_id % 10) > 1""")
def duplicate_leak(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), (F.col("doc_id") % 10).alias("g"))
    return split.spanning_keys(docs, "key", "g")


@query(f"""
WITH s AS (SELECT count(*) AS n FROM (SELECT p_brand FROM (SELECT p_brand, {_SPLIT.format(k='p_brand')} AS g FROM part) GROUP BY 1 HAVING count(DISTINCT g) > 1)),
     f AS (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
SELECT (SELECT n FROM s) = 0 AS passed, (SELECT (n > 0)::BIGINT FROM f) AS reviews""")
def leakage_gate(spark, d):
    parts = table(spark, d, "part").withColumn("g", split.split_group(F.col("p_brand"), "s1"))
    a = split.spanning_keys(parts, "p_brand", "g").agg(F.lit("scaffold").alias("check"), F.when(F.count(F.lit(1)) == 0, "PASS").otherwise("FAIL").alias("status"))
    lost = split.disjoint(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])
    b = lost.agg(F.lit("near_duplicate").alias("check"), F.when(F.count(F.lit(1)) == 0, "PASS").otherwise("REVIEW").alias("status"))
    return split.leakage_gate(a.unionByName(b), ["scaffold"])


_CUSTOMERS = "SELECT c_custkey FROM customer WHERE c_custkey {op} (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def _external(spark, d):
    a = table(spark, d, "customer").select("c_custkey")
    return a, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))


@query(_CUSTOMERS.format(op="IN"))
def external_overlap(spark, d):
    return split.overlap(*_external(spark, d), ["c_custkey"])


@query(_CUSTOMERS.format(op="NOT IN"))
def external_disjoint(spark, d):
    return split.disjoint(*_external(spark, d), ["c_custkey"])


@query("""
SELECT 'left' AS side, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'right', o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 50 = 0""")
def reproducibility_diff(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias("surrogate"))
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("surrogate", -F.col("surrogate"))
    return split.difference(a, b, ("surrogate",))


@query("""
SELECT count(*) AS n, count(DISTINCT c_nationkey) AS n_keys, 0::BIGINT AS missing, min(c_acctbal) AS min, round(median(c_acctbal), 6) AS median, max(c_acctbal) AS max,
       count(*) FILTER (c_acctbal <= 0) AS impossible, count(*) FILTER (c_acctbal > 9000) AS suspicious, count(*) - count(DISTINCT c_nationkey) AS repeated,
       CASE WHEN count(*) FILTER (c_acctbal <= 0) > 0.2 * count(*) THEN 'STOP' ELSE 'PROCEED' END AS verdict FROM customer""")
def profile_values(spark, d):
    return rounded(profile.profile(table(spark, d, "customer"), "c_nationkey", "c_acctbal", 9000, 0.2), "median")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM events GROUP BY event_type")
def histogram_fraction(spark, d):
    return rounded(profile.histogram(table(spark, d, "events"), "event_type"), "fraction")


@query("SELECT year, count(*) AS n FROM (SELECT DISTINCT o_custkey, year(o_orderdate)::VARCHAR AS year FROM orders) GROUP BY year")
def explode_years(spark, d):
    years = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat_ws(";", F.collect_set(F.year("o_orderdate").cast("string"))).alias("years"))
    return profile.exploded_counts(years, "years", "year")


@query("SELECT count(*) AS n, sum(quality)::BIGINT AS positive, round(avg(quality), 6) AS fraction FROM labels")
def label_distribution(spark, d):
    return rounded(profile.label_distribution(table(spark, d, "labels"), "quality"), "fraction")


@query("""
SELECT sum(p)::BIGINT AS positive, sum(n)::BIGINT AS negative, count(*) FILTER (p = 1 AND n = 1) AS both
FROM (SELECT source, max((quality = 1)::INT) AS p, max((quality = 0)::INT) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def scaffolds_by_class(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return profile.both_classes(joined, "source", "quality")


@query("""
SELECT count(*) AS attempted, count(*) FILTER (n_chars >= 200) AS processed, count(*) FILTER (n_chars < 200) AS quarantined,
       count(*) FILTER (n_chars > 5000) AS n_long, count(*) FILTER (lang <> 'en') AS n_foreign FROM documents""")
def run_report(spark, d):
    docs = table(spark, d, "documents").select(
        F.when(F.col("n_chars") < 200, "too short").alias("error"),
        F.array_compact(F.array(F.when(F.col("n_chars") > 5000, "long"), F.when(F.col("lang") != "en", "foreign"))).alias("flags"),
    )
    return profile.run_report(docs, "error", "flags", ["long", "foreign"])


@query("""
SELECT 'ok' AS side, count(*) AS n FROM documents WHERE n_chars >= 200 UNION ALL SELECT 'quarantined', count(*) FROM documents WHERE n_chars < 200""")
def quarantine_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 200, "too short").alias("reason"))
    good, bad = profile.quarantine(docs, "reason")
    of = lambda x, side: x.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return of(good, "ok").unionByName(of(bad, "quarantined"))


@query("""
WITH r AS (SELECT l_partkey, avg(log10(l_extendedprice)) FILTER (l_returnflag = 'A') - avg(log10(l_extendedprice)) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(stddev_samp(r), 6) AS sd, round(avg((abs(r) > 1)::INT), 6) AS over_1,
       round(avg((abs(r) > 0.5)::INT), 6) AS over_half FROM r WHERE r IS NOT NULL""")
def paradigm_ratio(spark, d):
    return rounded(agg.paradigm_ratio(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_extendedprice", "A", "R"), "mean", "median", "sd", "over_1", "over_half")


@query("""
SELECT l_partkey, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS n_categories, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') > 1 AS mixed,
       log10(max(l_extendedprice) / min(l_extendedprice)) > 0.8 AS discordant FROM lineitem GROUP BY 1""")
def mixed_paradigm(spark, d):
    return agg.mixed_categories(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_extendedprice", "N", 0.8)


@query("""
WITH c AS (SELECT l_returnflag AS i, l_linestatus AS e, count(*)::DOUBLE AS a FROM lineitem WHERE l_linenumber < 9 GROUP BY 1, 2),
t AS (SELECT *, sum(a) OVER (PARTITION BY i) - a AS b, sum(a) OVER (PARTITION BY e) - a AS c, sum(a) OVER () - sum(a) OVER (PARTITION BY i) - sum(a) OVER (PARTITION BY e) + a AS d FROM c)
SELECT i AS l_returnflag, e AS l_linestatus, a::BIGINT AS a, round(a / (a + b) / (c / (c + d)), 6) AS prr, round(a * d / (b * c), 6) AS ror,
       round(exp(ln(a * d / (b * c)) - 1.96 * sqrt(1/a + 1/b + 1/c + 1/d)), 6) AS ror_low, round(exp(ln(a * d / (b * c)) + 1.96 * sqrt(1/a + 1/b + 1/c + 1/d)), 6) AS ror_high
FROM t WHERE b > 0 AND c > 0 AND d > 0""")
def disproportionality(spark, d):
    rows = table(spark, d, "lineitem").withColumn("one", F.lit(1).cast("long"))
    return rounded(agg.disproportionality(rows, "l_returnflag", "l_linestatus", "one"), "prr", "ror", "ror_low", "ror_high")


@query(f"SELECT tier, count(*) AS n, round(sum(l_quantity::DECIMAL(12,2))::DOUBLE, 2) AS quantity FROM (SELECT {TIER} AS tier, l_quantity FROM lineitem) WHERE tier IN ('green', 'amber') GROUP BY tier")
def tier_filter(spark, d):
    rows = tiered(spark, d).where(F.col("tier").isin("green", "amber"))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double"), 2).alias("quantity"))


@query("""
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') >= 5 AND bool_or(l_tax > 0.05) AS panel_positive, count(DISTINCT l_suppkey) FILTER (l_linestatus = 'F') AS strains FROM lineitem GROUP BY 1""")
def panel_rollup(spark, d):
    f = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        ((F.count_if(f) >= 5) & F.bool_or(F.col("l_tax") > 0.05)).alias("panel_positive"), F.count_distinct(F.when(f, F.col("l_suppkey"))).alias("strains")
    )
