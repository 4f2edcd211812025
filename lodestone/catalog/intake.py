"""What comes in: raw activities, external labels, registries, model cards, landed objects, runs and their report."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import constraints, profile, selection
from lodestone.plans import flows
from lodestone.session import scratch_path, table
from lodestone.sources import landing, readers, writers

_RAW = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 11 > 0 THEN l_partkey::VARCHAR ELSE '' END AS molecule_id, CASE WHEN l_partkey % 13 > 0 THEN 'S' || l_suppkey END AS structure,
  CASE WHEN l_linenumber < 7 THEN l_quantity::BIGINT::VARCHAR ELSE '' END AS standard_value, CASE WHEN l_returnflag = 'R' THEN '>' WHEN l_suppkey % 5 > 0 THEN '=' END AS standard_relation,
  CASE l_suppkey % 7 WHEN 0 THEN 'Outside typical range' WHEN 1 THEN '' WHEN 2 THEN 'Potential author error' WHEN 3 THEN 'Manually validated' END AS validity_comment FROM lineitem"""
_FAULT = """CASE WHEN molecule_id = '' THEN 'no_molecule' WHEN structure IS NULL THEN 'no_structure' WHEN standard_value = '' THEN 'no_value' WHEN standard_relation IS DISTINCT FROM '=' THEN 'censored'
  WHEN validity_comment IN ('Outside typical range', 'Potential author error') THEN 'flagged' END"""
_FLAGS = ("Outside typical range", "Potential author error")


def _raw_activities(spark, d):
    supplier, flag = F.col("l_suppkey"), F.col("l_returnflag")
    comment = F.when(supplier % 7 == 0, _FLAGS[0]).when(supplier % 7 == 1, "").when(supplier % 7 == 2, _FLAGS[1]).when(supplier % 7 == 3, "Manually validated")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_orderkey") % 11 > 0, F.col("l_partkey").cast("string")).otherwise("").alias("molecule_id"),
        F.when(F.col("l_partkey") % 13 > 0, F.concat(F.lit("S"), supplier)).alias("structure"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("long").cast("string")).otherwise("").alias("standard_value"),
        F.when(flag == "R", ">").when(supplier % 5 > 0, "=").alias("standard_relation"), comment.alias("validity_comment"),
    )


@query(f"WITH raw AS ({_RAW}) SELECT id, molecule_id, standard_value::DOUBLE AS value FROM raw WHERE {_FAULT} IS NULL")
def usable_activities(spark, d):
    """Activities with an identifier, a structure, an exact value and no comment against them."""
    return readers.usable_activities(_raw_activities(spark, d), _FLAGS).select("id", "molecule_id", F.expr("try_cast(standard_value as double)").alias("value"))


@query(f"WITH raw AS ({_RAW}), x AS (SELECT {_FAULT} AS fault FROM raw) SELECT fault, count(*) AS n FROM x WHERE fault IS NOT NULL GROUP BY 1")
def activity_drops(spark, d):
    """How many activities are left out, by the first reason."""
    return readers.activity_drops(_raw_activities(spark, d), _FLAGS)


_EXTERNAL = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Inactive' WHEN 'O' THEN 'Active' ELSE 'Inconclusive' END AS outcome, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 20000 END AS potency FROM orders"""
_LABEL = "CASE WHEN outcome = 'Inconclusive' THEN NULL WHEN outcome = 'Inactive' AND potency IS NULL THEN 0 WHEN potency IS NOT NULL THEN (potency * 1000 <= 10000)::INT END"


def _external(spark, d):
    status = F.col("o_orderstatus")
    df = table(spark, d, "orders").select("o_orderkey", F.when(status == "F", "Inactive").when(status == "O", "Active").otherwise("Inconclusive").alias("outcome"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 20_000).alias("potency"))
    return readers.external_rows(df, "outcome", "potency", 10_000)


@query(f"SELECT * FROM (SELECT o_orderkey, {_LABEL} AS label FROM ({_EXTERNAL})) WHERE label IS NOT NULL")
def external_labels(spark, d):
    """Labels of an external set, from outcome and potency."""
    return _external(spark, d)[0].select("o_orderkey", "label")


@query(f"SELECT outcome, count(*) AS n FROM ({_EXTERNAL}) WHERE {_LABEL} IS NULL GROUP BY 1")
def external_drops(spark, d):
    """Rows of the external set without a label, by outcome."""
    return _external(spark, d)[1]


@query("SELECT s_suppkey::VARCHAR AS tag, s_name AS name, CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal END AS potency FROM supplier")
def screening_export(spark, d):
    """Suppliers through a screening export with three rows of description and numbers that aren't any."""
    path = scratch_path(spark, "screening")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("tag"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 6 > 0, F.col("s_acctbal").cast("string")).otherwise("n/a").alias("potency"))
    described = spark.createDataFrame([("RESULT_TYPE", "STRING", "FLOAT"), ("RESULT_DESCR", "of a supplier", "a number"), ("RESULT_UNIT", "", "uM")], rows.schema)
    described.unionByName(rows).write.csv(path, header=True, escape='"')
    return readers.read_screening_csv(spark, path, ["tag", "name", "potency"], "tag", "potency")


@query("""SELECT 'nation_' || n_nationkey AS source_id, n_name AS name, ['green', 'amber', 'red'][1 + n_nationkey % 3] AS tier, n_nationkey % 2 = 0 AS commercial_ok, (n_nationkey % 4)::INT AS portions FROM nation""")
def source_registry(spark, d):
    """A YAML registry with a source for each nation, landed as an object and read as rows."""
    key, folder = F.col("n_nationkey"), scratch_path(spark, "registry")
    tier = F.when(key % 3 == 0, "green").when(key % 3 == 1, "amber").otherwise("red")
    portions = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= key % 4, F.concat(F.lit("{portion: p"), i, F.lit("}")))), ", ")
    entry = F.concat(
        F.lit("- source_id: nation_"), key, F.lit("\n  name: '"), "n_name", F.lit("'\n  license: {tier: "), tier, F.lit(", commercial_ok: "), F.when(key % 2 == 0, "partial").otherwise("no"),
        F.lit(", split_licensing: ["), portions, F.lit("]}\n"),
    )
    # A part for each source: the object's writer streams them in order, no row holds the whole document.
    parts = table(spark, d, "nation").select(F.lit("sources.yaml").alias("key"), (key + 1).alias("part"), F.encode(entry, "UTF-8").alias("content"), F.lit(None).cast("string").alias("sha256"))
    head = spark.createDataFrame([("sources.yaml", 0, b"sources:\n", None)], "key string, part int, content binary, sha256 string")
    landing.land(head.unionByName(parts), folder)
    return readers.load_registry(spark, f"{folder}/sources.yaml").select("source_id", "name", "tier", "commercial_ok", "portions")


@query("SELECT 'supplier_' || s_suppkey AS model_id, 'v' || s_nationkey AS version, s_name AS endpoint FROM supplier WHERE s_suppkey % 10 > 0")
def model_cards(spark, d):
    """A card for each supplier, landed as a JSON object of several lines; one in ten is cut off and is left out."""
    folder, key = scratch_path(spark, "cards"), F.col("s_suppkey")
    card = F.concat(F.lit('{\n  "model_id": "supplier_'), key, F.lit('",\n  "version": "v'), "s_nationkey", F.lit('",\n  "endpoint": "'), "s_name", F.lit('",\n  "status": "active"\n}'))
    content = F.encode(F.when(key % 10 > 0, card).otherwise(F.substr(card, F.lit(1), F.lit(30))), "UTF-8")
    rows = table(spark, d, "supplier").select(F.concat(key, F.lit(".json")).alias("key"), F.lit(0).alias("part"), content.alias("content"), F.sha2(content, 256).alias("sha256"))
    landing.land(rows, folder)
    return readers.read_model_registry(spark, folder).where("model_id is not null").select("model_id", "version", "endpoint")


@query("""WITH x AS (SELECT page_id::VARCHAR || '.html' AS key, sha256(CASE WHEN page_id % 9 = 0 THEN url ELSE html END) AS recorded, sha256(html) AS content, page_id % 20 <> 7 AS is_recorded, page_id % 25 <> 0 AS is_there FROM pages WHERE html IS NOT NULL)
SELECT * FROM (SELECT key, CASE WHEN is_recorded THEN recorded END AS sha256, CASE WHEN is_there THEN content END AS found, CASE WHEN NOT is_recorded AND is_there THEN 'unrecorded' WHEN is_recorded AND NOT is_there THEN 'missing' WHEN is_recorded AND recorded <> content THEN 'changed' END AS fault FROM x) WHERE fault IS NOT NULL""")
def landing_audit(spark, d):
    """Landed pages against a record in which some are absent, some differ and some are left out."""
    folder, k, html = scratch_path(spark, "audited"), F.col("page_id"), F.encode("html", "UTF-8")
    pages = table(spark, d, "pages").where("html is not null").withColumn("key", F.concat(k.cast("string"), F.lit(".html")))
    landing.land(pages.where(k % 25 != 0).select("key", F.lit(0).alias("part"), html.alias("content"), F.sha2(html, 256).alias("sha256")), folder)
    recorded = pages.where(k % 20 != 7).select("key", F.upper(F.sha2(F.when(k % 9 == 0, F.encode("url", "UTF-8")).otherwise(html), 256)).alias("sha256"))
    return landing.audited(spark, folder, recorded)


@query("""SELECT coalesce(source, '') AS source_id, coalesce(lang, '') AS version, sha256(count(*)::VARCHAR) AS sha256, CASE WHEN coalesce(lang, '') = 'en' THEN 1 ELSE 2 END AS batch FROM documents GROUP BY 1, 2, 4""")
def snapshot_log(spark, d):
    """Snapshots recorded in three runs that overlap: each is there once, from the run that brought it first."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    found = table(spark, d, "documents").groupBy(empty("source").alias("source_id"), empty("lang").alias("version")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("sha256"))
    path = scratch_path(spark, "snapshots")
    for batch, rows in enumerate((found.where("version = 'en'"), found, found), 1):
        writers.record_snapshot(rows.withColumn("batch", F.lit(batch)), path)
    return spark.read.parquet(path)


_RUNS = """SELECT o_orderkey AS run_id, o_orderkey % 4 > 0 AS done, o_orderkey % 12 = 0 AS failed, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 5 - 1 END AS days, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 10 = 1)::INT END AS surplus FROM orders"""


@query(f"""WITH x AS ({_RUNS}) SELECT 'completed_after_start' AS rule, run_id::VARCHAR AS key FROM x WHERE days < 0 UNION ALL SELECT 'terminal_is_completed', run_id::VARCHAR FROM x WHERE failed AND NOT done
UNION ALL SELECT 'imported_within_parsed', run_id::VARCHAR FROM x WHERE surplus > 0""")
def run_constraints(spark, d):
    """Runs from their events, and those that break a rule of runs."""
    orders, k, start = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    parsed, day = F.col("o_custkey") % 50, lambda n: start + F.make_dt_interval(n.cast("int"))
    done = flows.completed_run(k, day(F.col("o_custkey") % 5 - 1), parsed, parsed + (k % 10 == 1).cast("int"))
    failed = flows.started_run(k, day(F.lit(1))).withField("state", F.lit("failed"))
    events = F.array(flows.started_run(k, start), F.when(k % 4 > 0, done), F.when(k % 12 == 0, failed))
    status = flows.run_status(orders.select(F.inline(F.array_compact(events))))
    c = F.col
    # A run that ended before it began has its start for the latest event, so its end counts too.
    terminal = c("state").isin("completed", "failed") | c("completed_at").isNotNull()
    return constraints.violations(status, "run_id", constraints.run_rules(c("started_at"), c("completed_at"), terminal, c("parsed"), c("imported")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def paired_records(spark, d):
    """Line numbers and parts of an order as two arrays, and back as pairs by position."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))  # an order's few lines
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("_l")).select("l_orderkey", F.col("_l.l_linenumber").alias("numbers"), F.col("_l.l_partkey").alias("parts"))
    return orders.select("l_orderkey", F.inline(selection.paired(F.col("numbers"), F.col("parts"))).alias("l_linenumber", "l_partkey"))


@query("""WITH x AS (SELECT doc_id, n_chars, lang, sha256(coalesce(text, '')) AS digest, CASE WHEN n_chars < 200 THEN 'too short' WHEN n_chars > 20000 THEN 'too long' END AS error FROM documents),
c AS (SELECT count(*) AS n, count(*) FILTER (error IS NULL) AS good, count(*) FILTER (lang <> 'en') AS foreign_, count(*) FILTER (n_chars > 5000) AS long_, avg(n_chars) FILTER (error IS NULL) AS mean, min(n_chars) FILTER (error IS NULL) AS lo, max(n_chars) FILTER (error IS NULL) AS hi FROM x)
SELECT 1 AS section, '1' AS item, '- Records attempted: ' || n AS line FROM c UNION ALL SELECT 1, '2', '- Processed: ' || good FROM c UNION ALL SELECT 1, '3', '- Quarantined: ' || (n - good) FROM c
UNION ALL SELECT 2, doc_id::VARCHAR, '| ' || doc_id || ' | ' || error || ' |' FROM x WHERE error IS NOT NULL
UNION ALL SELECT 3, 'foreign', '- foreign: ' || foreign_ FROM c UNION ALL SELECT 3, 'long', '- long: ' || long_ FROM c
UNION ALL SELECT 4, digest, '- `' || digest || '`: ' || count(*) || ' records, first ' || min(doc_id) FROM x WHERE error IS NULL GROUP BY digest HAVING count(*) > 1
UNION ALL SELECT 5, 'n_chars', '- n_chars: mean ' || printf('%.1f', round(mean, 1)) || ', min ' || printf('%.1f', lo::DOUBLE) || ', max ' || printf('%.1f', hi::DOUBLE) FROM c""")
def quality_report(spark, d):
    """The report of a run over the documents, as lines."""
    n = F.col("n_chars")
    docs = table(spark, d, "documents").select(
        "doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.when(n < 200, "too short").when(n > 20_000, "too long").alias("error"),
        F.array_compact(F.array(F.when(F.col("lang") != "en", "foreign"), F.when(n > 5_000, "long"))).alias("flags"),
    )
    return profile.quality_report(docs, "doc_id", "error", "flags", ["foreign", "long"], ["n_chars"], "digest")
