"""Landing, services, change capture, restored tables, elements, examples of bits, sketches and SQL functions."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.catalog.models import _SIDES
from lodestone.functions import scalars, sql
from lodestone.operators import drift, reliability, selection, similarity, sketches, split
from lodestone.session import scratch_path, table
from lodestone.sources import landing, readers, service, writers
from lodestone.streaming import changes


@query("SELECT 'pages/' || page_id || '.html' AS key, sha256(html) AS sha256, strlen(html) AS bytes, (strlen(html) + 999) // 1000 AS chunks FROM pages")
def landed_pages(spark, d):
    """Every page as an object that had to have its recorded digest; then read back in chunks."""
    folder = scratch_path(spark, "zone")
    html = F.encode("html", "UTF-8")
    pages = table(spark, d, "pages").where("html is not null").select(F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("key"), F.lit(0).alias("part"), html.alias("content"), F.sha2(html, 256).alias("sha256"))
    landing.land(pages, folder)
    found = landing.manifest(spark, folder)
    again = landing.contents(found, folder, 1_000).groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).alias("_bytes"))
    return found.join(again, "key").where(F.col("bytes") == F.col("_bytes")).select("key", "sha256", "bytes", "chunks")


@query("SELECT c_custkey, c_name FROM customer")
def service_rows(spark, d):
    """The customers from a service that pages through the table, tells no total and fails now and then."""
    path, asked = os.path.join(urlparse(d).path if "://" in d else d, "customer.parquet"), [0]

    def fetch(offset, limit):
        import pyarrow.parquet as pq

        asked[0] += 1
        if asked[0] % 7 == 3:
            raise service.Unavailable("503")
        rows = pq.read_table(path, columns=["c_custkey", "c_name"])
        page = rows.slice(offset, limit).to_pylist()
        return [(r["c_custkey"], r["c_name"]) for r in page], offset + limit < rows.num_rows

    spark.dataSource.register(service.service_source("customers", "c_custkey long, c_name string", fetch, size=100, pages_each=4, pause=0.01))
    return spark.read.format("customers").load()


@query("""WITH m AS (SELECT c_nationkey::VARCHAR AS key, c_custkey AS seq, c_acctbal < 1000 AS gone, '{"c_mktsegment":"' || c_mktsegment || '"}' AS content FROM customer),
x AS (SELECT *, lag(content) OVER w AS old, lag(gone) OVER w AS was FROM m WINDOW w AS (PARTITION BY key ORDER BY seq)),
y AS (SELECT key, seq, CASE WHEN old IS NULL THEN 'insert' WHEN gone AND NOT was THEN 'soft_delete' WHEN was AND NOT gone THEN 'restore' WHEN content <> old THEN 'update' END AS operation, old AS old_values, content AS new_values FROM x)
SELECT * FROM y WHERE operation IS NOT NULL""")
def change_capture(spark, d):
    """Customers as messages on their nations, every third one sent twice, in two starts of a stream."""
    key, value = changes.STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    messages, out = scratch_path(spark, "messages"), scratch_path(spark, "changes")
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", (F.col("c_acctbal") < 1000).alias("gone"))
    half = c.agg(F.percentile_approx("c_custkey", 0.5)).first()[0]
    try:
        for part in (c.where(F.col("c_custkey") <= half), c.where((F.col("c_custkey") > half) | (F.col("c_custkey") % 3 == 0))):
            part.unionByName(part.where("c_custkey % 3 = 0")).coalesce(1).write.mode("append").parquet(messages)
            stream = changes.change_stream(spark.readStream.schema(c.schema).parquet(messages), "c_nationkey", "c_custkey", ["c_mktsegment"], "gone", seen_ms=None)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(changes.CHANGES).parquet(out)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderstatus) || '!' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replaced_and_restored(spark, d):
    """A table replaced by one made from itself, backed up, damaged, and restored from the copy."""
    path, copy = scratch_path(spark, "orders"), scratch_path(spark, "copy")
    writers.write_once(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path)
    now = spark.read.parquet(path)
    now = writers.replace(now.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.upper("o_orderstatus"), F.lit("!"))).otherwise(F.col("o_orderstatus"))), path)
    writers.back_up(spark, path, copy)
    recorded = tuple(writers.content_digest(now).first())
    writers.replace(now.where("o_orderkey % 3 = 0"), path)
    writers.restore(spark, copy, recorded, path, force=True)
    return spark.read.parquet(path)


@query("SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'unknown') AS category FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 > 0) p ON p_partkey = l_partkey")
def category_lookup(spark, d):
    """Each line's category, `unknown` where no part tells it."""
    known = table(spark, d, "part").where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("category"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return selection.looked_up(lines, known, ["l_partkey"], {"category": "unknown"}).select("l_orderkey", "l_linenumber", "category")


_FORMULA = "f AS (SELECT p_partkey, 'C' || (p_size + 1) || 'H' || (p_size * 2) || CASE WHEN p_partkey % 17 = 0 THEN 'Br' WHEN p_partkey % 23 = 0 THEN 'B2' ELSE 'O' END || CASE WHEN p_partkey % 5 = 0 THEN 'C3Cl2' ELSE 'N' END || CASE WHEN p_partkey % 7 = 0 THEN '+2' ELSE '' END AS formula, p_size FROM part)"


def _formulas(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    formula = F.concat(
        F.lit("C"), (s + 1).cast("string"), F.lit("H"), (s * 2).cast("string"), F.when(k % 17 == 0, "Br").when(k % 23 == 0, "B2").otherwise("O"), F.when(k % 5 == 0, "C3Cl2").otherwise("N"), F.when(k % 7 == 0, "+2").otherwise("")
    )
    return table(spark, d, "part").select("p_partkey", "p_size", formula.alias("formula"))


@query(f"""WITH {_FORMULA}, a AS (SELECT p_partkey, unnest(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*')) AS atom FROM f),
c AS (SELECT p_partkey, regexp_extract(atom, '[A-Z][a-z]?') AS element, sum(coalesce(nullif(regexp_extract(atom, '[0-9]+'), ''), '1')::INT)::INT AS n FROM a GROUP BY ALL)
SELECT p_partkey, string_agg(element || '=' || n, ',' ORDER BY element) AS elements FROM c GROUP BY 1""")
def formula_elements(spark, d):
    counts = F.transform(F.array_sort(F.map_entries(scalars.elements(F.col("formula")))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _formulas(spark, d).select("p_partkey", F.array_join(counts, ",").alias("elements"))


@query(f"""WITH {_FORMULA}, known AS (SELECT list(DISTINCT e) AS es FROM (SELECT unnest(regexp_extract_all(formula, '[A-Z][a-z]?')) AS e FROM f WHERE p_partkey % 10 < 7 AND p_partkey % 17 > 0 AND p_partkey % 23 > 0)),
u AS (SELECT p_partkey, p_size, list_sort(list_filter(list_distinct(regexp_extract_all(formula, '[A-Z][a-z]?')), lambda e: NOT list_contains(es, e))) AS unseen FROM f, known WHERE p_partkey % 10 >= 7)
SELECT p_partkey, array_to_string(unseen, ',') AS unseen, CASE WHEN len(unseen) > 0 OR p_size < 10 THEN 'out_of_domain' ELSE 'in_domain' END AS verdict FROM u""")
def novel_elements(spark, d):
    """Elements that no training row has force a row out of the domain."""
    f = _formulas(spark, d)
    train = f.where("p_partkey % 10 < 7 and p_partkey % 17 > 0 and p_partkey % 23 > 0")
    known = train.select(F.explode(F.map_keys(scalars.elements(F.col("formula")))).alias("e")).agg(F.collect_set("e").alias("known"))  # the elements there are
    rows = f.where("p_partkey % 10 >= 7").join(F.broadcast(known)).withColumn("_unseen", scalars.unseen_elements(F.col("formula"), F.col("known")))
    verdict = reliability.verdict_with_elements(F.when(F.col("p_size") < 10, "out_of_domain").otherwise("in_domain"), F.col("_unseen"))
    return rows.select("p_partkey", F.array_join("_unseen", ",").alias("unseen"), verdict.alias("verdict"))


@query(f"""WITH {_SIDES}, t AS (SELECT bit, round(avg((label < 5)::INT) - avg((label >= 5)::INT), 9) AS importance FROM b JOIN v USING (vec_id) GROUP BY bit ORDER BY importance DESC, bit LIMIT 10)
SELECT t.bit, round(importance, 6) AS importance, (row_number() OVER o)::INT AS example, vec_id FROM t JOIN b USING (bit) WINDOW o AS (PARTITION BY t.bit ORDER BY md5('42:' || vec_id), vec_id) QUALIFY row_number() OVER o <= 2""")
def bit_examples(spark, d):
    """Ten bits by a given importance, each with two vectors that set it."""
    v = table(spark, d, "embeddings").select("vec_id", "label", similarity.on_bits(F.col("embedding")).alias("bits"))
    sign = F.avg((F.col("label") < 5).cast("int")) - F.avg((F.col("label") >= 5).cast("int"))
    top = v.select("label", F.explode("bits").alias("bit")).groupBy("bit").agg(F.round(sign, 9).alias("importance")).orderBy(F.desc("importance"), "bit").limit(10)
    return selection.bit_examples(v, "vec_id", "bits", top).select("bit", F.round("importance", 6).alias("importance"), "example", "vec_id")


_EXACT = """SELECT '{c}' AS "column", count(*) FILTER (l_orderkey % 2 = 0) AS old_n, count(*) FILTER (l_orderkey % 2 = 1) AS new_n, round(avg(({v} IS NULL)::INT) FILTER (l_orderkey % 2 = 0), 6) AS old_null_rate,
  round(avg(({v} IS NULL)::INT) FILTER (l_orderkey % 2 = 1), 6) AS new_null_rate, TRUE AS distinct_holds, TRUE AS distance_holds FROM lineitem"""
_MONITORED = {"l_quantity": "CASE WHEN l_quantity > 45 AND l_orderkey % 2 = 1 THEN NULL ELSE l_quantity + 5 * (l_orderkey % 2) END", "l_extendedprice": "l_extendedprice", "l_partkey": "l_partkey", "l_returnflag": "nullif(l_returnflag, 'N')"}


@query(" UNION ALL ".join(_EXACT.format(c=c, v=v) for c, v in _MONITORED.items()))
def column_monitors(spark, d):
    """Two releases by sketches of their halves, merged; and whether estimates lie within four times their stated
    errors of the exact figures, which are counted beside them."""
    odd = F.col("l_orderkey") % 2 == 1
    quantity = F.when((F.col("l_quantity") > 45) & odd, None).otherwise(F.col("l_quantity") + 5 * (F.col("l_orderkey") % 2))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quantity.alias("l_quantity"), "l_extendedprice", "l_partkey", F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"))
    sides = {"old": rows.where(~odd), "new": rows.where(odd)}
    names = list(_MONITORED)
    kept = {k: sketches.merged(*[sketches.sketched(v.where(f"l_linenumber % 2 = {i}"), names) for i in (0, 1)]) for k, v in sides.items()}
    exact = None
    for c in names:
        one = sides["old"].agg(F.count_distinct(c).alias("_old")).crossJoin(sides["new"].agg(F.count_distinct(c).alias("_new"))).withColumn("column", F.lit(c))  # a row of one each
        text = c == "l_returnflag"
        one = one.withColumn("ks", F.lit(None).cast("double")) if text else one.crossJoin(drift.kolmogorov_smirnov(sides["old"], sides["new"], c))
        exact = one if exact is None else exact.unionByName(one)
    found = sketches.monitored(kept["old"], kept["new"]).join(exact, "column")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4 * sketches.DISTINCT_ERROR * F.col(b) + 1
    holds = F.coalesce(F.col("distance") <= F.col("ks") + 4 * sketches.RANK_ERROR + 0.01, F.col("ks").isNull()) & F.coalesce(F.col("distance") >= F.col("ks") - 4 * sketches.RANK_ERROR - 0.01, F.col("ks").isNull())
    return found.select(
        "column", "old_n", "new_n", F.round("old_null_rate", 6).alias("old_null_rate"), F.round("new_null_rate", 6).alias("new_null_rate"), (near("old_distinct", "_old") & near("new_distinct", "_new")).alias("distinct_holds"), holds.alias("distance_holds")
    )


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN 'out_of_domain' ELSE ['in_domain', 'borderline', 'out_of_domain', 'out_of_domain'][1 + (p_size < 30)::INT + (p_retailprice > 1200)::INT + (p_partkey % 3 = 0)::INT] END AS verdict,
  CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size * 3.5 <= 75 THEN 0.85 WHEN p_size * 3.5 < 150 THEN 0.56 ELSE 0.11 END WHEN (p_retailprice / 3 > 500)::INT + (p_size / 7.0 - 1 > 5)::INT + (p_size % 9 > 5)::INT + (p_size % 13 > 10)::INT <= 1 THEN 0.55 ELSE 0.17 END::DOUBLE AS score,
  (p_size > 5)::BIGINT + (p_size < 45)::BIGINT AS labels FROM part""")
def sql_functions(spark, d):
    """Verdict, score and size of the prediction set in plain SQL, by functions of the session."""
    sql.register(spark)
    table(spark, d, "part").createOrReplaceTempView("lodestone_parts")
    return spark.sql("""
        WITH x AS (SELECT p_partkey, domain_verdict(p_size / 50D, p_retailprice, 1200D, p_partkey % 3 <> 0) AS verdict,
            bioavailability_score(int(p_size % 3) - 1, double(p_size * 3.5), lipinski_violations(p_retailprice / 3, double(p_size / 7.0 - 1), int(p_size % 9), int(p_size % 13)) <= 1) AS score, p_size FROM lodestone_parts)
        SELECT p_partkey, verdict, score, count(s.label) AS labels FROM x LEFT JOIN LATERAL prediction_set(CASE WHEN p_size > 5 THEN 0.5D ELSE 0.05D END, CASE WHEN p_size < 45 THEN 0.5D ELSE 0.05D END) s
        GROUP BY p_partkey, verdict, score, p_size""")


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN NULL ELSE p_brand END, ''), p_name) AS scaffold, 'chem-' || p_brand || '__python-3.13__stdpipe-' || p_size AS toolchain,
  coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0)::DOUBLE AS filled, sha256(p_name) = sha256(CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END) AS digest_matches,
  CASE WHEN p_size % 5 > 0 THEN p_brand || '|2024-01-0' || (p_size % 9 + 1) || '|' || left(sha256(p_name), 12) END AS parsed FROM part""")
def record_scalars(spark, d):
    """Scaffold key, toolchain identifier, filled numbers, digests in capitals and parsed snapshot identifiers."""
    s, name = F.col("p_size"), F.col("p_name")
    raw = F.when(s % 4 == 0, "").when(s % 4 != 1, F.col("p_brand"))
    day = F.to_date(F.concat(F.lit("2024-01-0"), (s % 9 + 1).cast("string")))
    snapshot = F.when(s % 5 > 0, scalars.snapshot_id(F.col("p_brand"), day, F.sha2(name, 256))).otherwise(F.lit("no snapshot"))
    parsed = scalars.parse_snapshot_id(snapshot)
    return table(spark, d, "part").select(
        "p_partkey", split.scaffold_key(raw, name).alias("scaffold"), scalars.toolchain_id(F.col("p_brand"), F.lit("3.13"), s.cast("string")).alias("toolchain"), scalars.filled(F.when(s % 2 == 0, s)).alias("filled"),
        scalars.digest_matches(name, F.upper(F.sha2(F.when(s % 3 == 0, F.col("p_type")).otherwise(name), 256))).alias("digest_matches"), F.when(parsed.isNotNull(), F.concat_ws("|", parsed["version"], parsed["day"], parsed["sha12"])).alias("parsed"),
    )


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def tsv_round_trip(spark, d):
    """Suppliers through tab-separated text and the declared schema."""
    df, path = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), scratch_path(spark, "suppliers")
    df.write.csv(path, sep="\t", header=True)
    return readers.read_tsv(spark, path, "s_suppkey long, s_name string, s_acctbal double")
