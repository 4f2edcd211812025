"""Synchronisation, exports, round trips through sources and sinks, row picks, model checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import models, query
from lodestone.catalog.data import rounded
from lodestone.catalog.models import _SCORED, scored
from lodestone.operators import fits, governance, metrics, ml, selection
from lodestone.session import scratch_path, table
from lodestone.sources import readers, writers


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'new ' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation""")
def registry_sync(spark, d):
    """Rows of four kinds: absent, renamed, unchanged, and only in the table."""
    a, k = table(spark, d, "nation"), F.col("n_nationkey") % 4
    existing = a.where(k != 0)
    registry = a.where(k != 3).withColumn("n_name", F.when(k == 1, F.concat(F.lit("new "), "n_name")).otherwise(F.col("n_name")))
    return governance.apply_sync(registry, existing, "n_nationkey", ["n_regionkey"], ["n_name"])


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def must_match(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return selection.must_match(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"])


@query("SELECT count(*) FILTER (contains(url, '?')) AS mixtures, count(*) AS rows FROM pages")
def mixture_exclusion(spark, d):
    return selection.without_mixtures(table(spark, d, "pages"), "url", "?")[1]


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 150000::DOUBLE / 3 AND 150000::DOUBLE * 3")
def near_threshold(spark, d):
    return table(spark, d, "orders").where(selection.near_threshold(F.col("o_totalprice"), 150_000.0)).select("o_orderkey")


@query(f"WITH {_SCORED} SELECT id, p FROM x WHERE y = 1 AND p < 0.5 ORDER BY p, id LIMIT 5")
def confident_false_negatives(spark, d):
    return selection.most_confident(scored(spark, d), "p", "y", "id", wrong=0).select("id", "p")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET (SELECT count(*) // 20 FROM orders)")
def percentile_row(spark, d):
    return selection.row_at_fraction(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.05)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50")
def seeded_sample(spark, d):
    return selection.seeded_sample(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


@query("SELECT s_suppkey AS k, s_acctbal AS balance, NULL::VARCHAR AS segment, 'internal' AS pool FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'external' FROM customer")
def pool_union(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return selection.pool_union(internal=a, external=b).select("k", "balance", "segment", "pool")


@query("""WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders), s AS (SELECT o_orderkey, m, unnest(range(0, 10)) AS i FROM o)
SELECT o_orderkey, (m + INTERVAL 1 MONTH)::DATE AS next_month, (m + i * INTERVAL 1 MONTH)::DATE AS month FROM s""")
def month_series(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", selection.month_bounds(day)["next"].alias("next_month"), F.explode(selection.month_series(day)).alias("month"))


@query("""SELECT vec_id FROM embeddings WHERE embedding[1] > 0 AND embedding[5] > 0 AND embedding[9] > 0 AND label % 2 = 0""")
def substructure_candidates(spark, d):
    bits = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    df = table(spark, d, "embeddings").withColumn("bits", bits)
    return selection.substructure_candidates(df, "bits", F.array(F.lit(0), F.lit(4), F.lit(8)), F.col("label") % 2 == 0).select("vec_id")


@query('''SELECT p_partkey, p_partkey || ',"' || p_name || ', ""' || p_type || '""",' || p_brand || '|' || p_size AS line FROM part''')
def csv_export_lines(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("quoted"), F.array("p_brand", F.col("p_size").cast("string")).alias("set"))
    return part.select("p_partkey", writers.csv_line(part).alias("line"))


@query("""SELECT o_orderkey, '{"deep":{"a":' || o_custkey || ',"b":[{"x":' || (round(o_totalprice / 3, 2) * 1)::VARCHAR || ',"y":1}]},"key":' || o_orderkey || '}' AS json FROM orders""")
def golden_json(spark, d):
    """Doubles at every depth, here to two digits."""
    x = F.col("o_totalprice") / 3
    df = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"), F.struct(F.array(F.struct(F.lit(1).alias("y"), x.alias("x"))).alias("b"), F.col("o_custkey").alias("a")).alias("deep")
    )
    return writers.export_json(df, 2).select(F.get_json_object("json", "$.key").cast("long").alias("o_orderkey"), "json")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Customers through a sorted CSV export and the declared schema; empty strings come back null."""
    df = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(""))
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    path = scratch_path(spark, "customers")
    writers.write_sorted_csv(df, path, "c_custkey")
    return readers.read_csv(spark, path, schema)


@query("SELECT count(*) AS rows, 'n_nationkey,n_name' AS columns, 'n_nationkey' AS sorted_by, TRUE AS digest_holds FROM nation")
def sorted_export(spark, d):
    """The manifest of an export, whose digest is computed again from the files."""
    path = scratch_path(spark, "export")
    manifest = writers.export_with_manifest(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "n_nationkey")
    parts = readers.landed_digests(spark, f"{path}/data").where(F.col("path").endswith(".csv")).select(F.struct("path", "sha256").alias("p"))
    again = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["sha256"]), ""), 256).alias("_sha"))
    return manifest.join(F.broadcast(again)).select("rows", "columns", "sorted_by", (F.col("sha256") == F.col("_sha")).alias("digest_holds"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def split_scan(spark, d):
    """A table partitioned by its split, of which two groups are read."""
    path = scratch_path(spark, "lines")
    writers.write_partitioned(table(spark, d, "lineitem"), path, "l_returnflag")
    return readers.read_split(spark, path, "l_returnflag", ["A", "R"], ["l_orderkey", "l_linenumber", "l_quantity"])


@query("""SELECT count(*) FILTER (o_orderkey % 3 = 0) AS first, 0::BIGINT AS again, count(*) FILTER (o_orderkey % 3 > 0) AS more, count(*) AS rows FROM orders""")
def append_twice(spark, d):
    """An append, the same again, and one of all rows, of which the others are new."""
    path = scratch_path(spark, "orders")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    third = orders.where("o_orderkey % 3 = 0")
    first, again, more = (F.lit(writers.append_absent(df, path, ["o_orderkey"])).cast("long") for df in (third, third, orders))
    return spark.read.parquet(path).agg(first.alias("first"), again.alias("again"), more.alias("more"), F.count(F.lit(1)).alias("rows"))


@query("SELECT 'all' AS target, count(*) AS rows FROM part UNION ALL SELECT 'sized', count(*) FROM part WHERE p_size % 3 > 0")
def fan_out(spark, d):
    df = table(spark, d, "part").withColumn("size", F.when(F.col("p_size") % 3 > 0, F.col("p_size")))
    counts = writers.fan_out(df, scratch_path(spark, "parts"), {"all": ["p_partkey"], "sized": ["p_partkey", "size"]}, {"sized": "size"}, "p_brand")
    return spark.createDataFrame(list(counts.items()), "target string, rows long")


@query("SELECT s_suppkey, 'rejected' AS outcome, 'NEGATIVE' AS reason, NULL::DOUBLE AS p FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 'scored', NULL, s_acctbal FROM supplier WHERE s_acctbal >= 0")
def prediction_log(spark, d):
    """Rejections and predictions in one log; the column p came later."""
    path, s = scratch_path(spark, "log"), table(spark, d, "supplier")
    writers.append_log(writers.rejections(s, F.when(F.col("s_acctbal") < 0, "NEGATIVE"), "s_suppkey"), path)
    writers.append_log(s.where("s_acctbal >= 0").select("s_suppkey", F.lit("scored").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.col("s_acctbal").alias("p")), path)
    return writers.read_log(spark, path).select("s_suppkey", "outcome", "reason", "p")


@query("SELECT r_regionkey, r_name FROM region")
def backed_up(spark, d):
    """A table behind a copy whose rows and digest agree, and a gate that knows the files' digests."""
    source, target = scratch_path(spark, "regions"), scratch_path(spark, "copy")
    writers.write_once(table(spark, d, "region").select("r_regionkey", "r_name"), source)
    if not writers.back_up(spark, source, target):
        raise ValueError("the copy differs")
    known = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in readers.landed_digests(spark, target).where(F.col("path").endswith(".parquet")).collect()}  # a few files
    return spark.read.parquet(readers.verified(spark, target, known))


def _rows(spark, found: dict) -> DataFrame:
    return spark.createDataFrame([(str(k), float(v.auc), float(v.balanced_accuracy)) for k, v in found.items()], "name string, auc double, balanced_accuracy double")


@query()
def model_baselines(spark, d):
    """Descriptors alone and three of them alone, each linear and as a forest, and labels by chance."""
    rows = models.learning(spark, d)
    train, test = models.weighed(rows, models.TRAIN), rows.where(models.TEST)
    several = {f"{n}_{k}": fits.Fit(e, train, test, "y") for n, v in (("descriptors", "descriptors"), ("three", "few")) for k, e in ml.baselines("y", "weight", v).items()}
    rate = train.agg(F.avg("y")).first()[0]
    chance = test.select("y", ml.stratified_baseline("vec_id", rate).cast("double").alias("p"))
    r = metrics.area_and_balance(metrics.score_counts(chance, "p", "y")).first()
    return _rows(spark, fits.outcomes(spark, several) | {"stratified": fits.Outcome(None, *r)})


@query()
def model_stability(spark, d):
    """The selected forest over ten seeds and ten bootstraps of the training rows."""
    rows = models.learning(spark, d)
    trees, depth, _ = models.best_forest(rows)
    make = lambda seed: ml.forest("y", "weight", trees, depth, seed)
    return _rows(spark, ml.stability(rows.where(models.TRAIN), rows.where(models.TEST), "vec_id", "y", make, tuple(range(2000, 2010)), tuple(range(10))))


@query()
def feature_ablation(spark, d):
    """The selected forest on descriptors, on bits and on both."""
    rows = models.learning(spark, d)
    trees, depth, _ = models.best_forest(rows)
    found = ml.ablation(rows.where(models.TRAIN), rows.where(models.TEST), "y", ["descriptors", "fingerprint", "features"], lambda v: ml.forest("y", "weight", trees, depth, features=v))
    return _rows(spark, found)


@query()
def split_gap(spark, d):
    """The selected forest under the given split and under a stratified random one."""
    rows = models.learning(spark, d)
    trees, depth, _ = models.best_forest(rows)
    return _rows(spark, ml.split_gap(rows, "vec_id", "y", models.TRAIN, models.TEST, lambda: ml.forest("y", "weight", trees, depth)))


@query()
def mahalanobis_distance(spark, d):
    v = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return rounded(ml.mahalanobis(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"), "v").select("vec_id", "mahalanobis"), "mahalanobis")


@query("SELECT CASE WHEN starts_with(p_type, 'PROMO') THEN 'promo' WHEN contains(p_type, 'STEEL') THEN 'steel' ELSE 'other' END AS kind, count(*) AS features, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS share FROM part GROUP BY 1")
def importance_shares(spark, d):
    """Of made-up importances: prices of parts by their types."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("feature"), F.col("p_retailprice").cast("double").alias("importance"))
    return rounded(ml.importance_shares(rows, {"promo": "^PROMO", "steel": "STEEL"}), "share")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return selection.row_of(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 7)
