"""Similarity, applicability domain, conformal sets, metrics, learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.catalog.data import rounded
from lodestone.operators import fits, metrics, ml, reliability, similarity
from lodestone.plans import flows
from lodestone.session import scratch_path, table

#: Every third vector asks, the others are the reference.
_SIDES = """
v AS (SELECT vec_id, label, embedding, vec_id % 3 = 0 AS q, list_filter(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN i - 1 END), lambda x: x IS NOT NULL) AS bits FROM embeddings),
b AS (SELECT vec_id, q, len(bits) AS n, unnest(bits) AS bit FROM v),
pairs AS (SELECT a.vec_id AS a_id, r.vec_id AS b_id, count(*) / (any_value(a.n) + any_value(r.n) - count(*)) AS similarity
          FROM b a JOIN b r ON a.bit = r.bit AND a.q AND NOT r.q GROUP BY 1, 2)"""


#: Numbers of a vector.
WIDTH = 64


def vectors(spark, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").withColumn("bits", similarity.on_bits(F.col("embedding")))
    return v.where("vec_id % 3 = 0"), v.where("vec_id % 3 <> 0")


@query(f"WITH {_SIDES} SELECT a_id, b_id, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.5")
def near_duplicates(spark, d):
    return rounded(similarity.tanimoto_join(*vectors(spark, d), "vec_id", "vec_id", "bits", 0.5), "similarity")


@query(f"WITH {_SIDES} SELECT vec_id, round(coalesce(max(similarity), 0), 6) AS max_similarity FROM v LEFT JOIN pairs ON a_id = vec_id WHERE q GROUP BY vec_id")
def tanimoto_max(spark, d):
    return rounded(similarity.max_similarity(*vectors(spark, d), "vec_id", "bits"), "max_similarity")


@query(f"""WITH {_SIDES}, m AS (SELECT vec_id, coalesce(max(similarity), 0) AS s FROM v LEFT JOIN pairs ON a_id = vec_id WHERE q GROUP BY vec_id)
SELECT CASE WHEN s >= 0.7 THEN 'highly_similar' WHEN s >= 0.4 THEN 'moderately_similar' WHEN s >= 0.2 THEN 'chemically_novel' ELSE 'out_of_domain' END AS tier, count(*) AS n FROM m GROUP BY 1""")
def similarity_tiers(spark, d):
    best = similarity.max_similarity(*vectors(spark, d), "vec_id", "bits")
    return best.groupBy(similarity.similarity_tier(F.col("max_similarity")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SIDES}, s AS (SELECT q.vec_id, r.vec_id AS neighbour_id, coalesce(similarity, 0)::DOUBLE AS similarity FROM v q JOIN v r ON q.q AND NOT r.q LEFT JOIN pairs ON a_id = q.vec_id AND b_id = r.vec_id)
SELECT vec_id, row_number() OVER w AS rank, neighbour_id, round(similarity, 6) AS similarity FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY similarity DESC, neighbour_id) QUALIFY row_number() OVER w <= 3""")
def evidence_neighbours(spark, d):
    """The three references most alike to each query, as its evidence."""
    q, r = vectors(spark, d)
    index = similarity.index_bits(r, "vec_id", "bits", scratch_path(spark, "index"))
    return rounded(similarity.neighbours(q, index, "vec_id", "bits", 3), "similarity")


@query("""WITH v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: x > 0) AS signs FROM embeddings),
e AS (SELECT embedding, count(*) AS n FROM v WHERE vec_id % 3 <> 0 GROUP BY 1), b AS (SELECT signs, count(*) AS n FROM v WHERE vec_id % 3 <> 0 GROUP BY 1)
SELECT vec_id, coalesce(e.n, 0) AS same_vector, coalesce(b.n, 0) AS same_bits
FROM v LEFT JOIN e ON v.embedding = e.embedding LEFT JOIN b ON v.signs = b.signs WHERE vec_id % 3 = 0""")
def exact_vector_collisions(spark, d):
    """Each query, and how many references have all its numbers, and all their signs."""
    q, r = (df.withColumn("signs", F.transform("embedding", lambda x: x > 0)) for df in vectors(spark, d))
    return similarity.same_keys(q, r, "vec_id", {"same_vector": "embedding", "same_bits": "signs"})


_STATS = "s AS (SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM (SELECT generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY i)"


@query(f"WITH {_STATS} SELECT i::INT AS i, round(mean, 6) AS mean, round(sd, 6) AS sd FROM s")
def scaler_stats(spark, d):
    return rounded(similarity.scaler(vectors(spark, d)[1], "embedding"), "mean", "sd")


_KNN = f"""{_STATS},
z AS (SELECT vec_id, list((x - mean) / sd ORDER BY i) AS z FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) JOIN s USING (i) GROUP BY vec_id),
d AS (SELECT q.vec_id, sqrt(list_sum(list_transform(list_zip(q.z, r.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
      FROM z q JOIN z r ON {{on}} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance) <= 5)"""
_CROSS, _SELF = "q.vec_id % 3 = 0 AND r.vec_id % 3 <> 0", "q.vec_id % 3 <> 0 AND r.vec_id % 3 <> 0 AND q.vec_id <> r.vec_id"


def _scaled(spark, d):
    q, r = vectors(spark, d)
    stats = similarity.scaler(r, "embedding")
    return similarity.scaled(q, "embedding", stats), similarity.scaled(r, "embedding", stats)


@query(f"WITH {_KNN.format(on=_CROSS)} SELECT vec_id, round(avg(distance), 5) AS knn_distance FROM d GROUP BY vec_id")
def knn_distance(spark, d):
    return rounded(similarity.nearest_distance(*_scaled(spark, d), "vec_id", "scaled"), "knn_distance", digits=5)


def _limit(r: DataFrame) -> DataFrame:
    near = similarity.nearest_distance(r, r, "vec_id", "scaled", exclude_self=True)
    p95 = metrics.quantiles(near, "knn_distance", [0.95])[0]
    return r.sparkSession.createDataFrame([(p95,)], "p95 double")


@query(f"WITH {_KNN.format(on=_SELF)}, k AS (SELECT vec_id, avg(distance) AS m FROM d GROUP BY vec_id) SELECT round(quantile_cont(m, 0.95), 5) AS p95 FROM k")
def knn_p95(spark, d):
    return rounded(_limit(_scaled(spark, d)[1]), "p95", digits=5)


_SIGNALS = f"""WITH {_SIDES}, {_KNN.format(on=_CROSS).replace("d AS (", "dq AS (")},
dr AS (SELECT q.vec_id, sqrt(list_sum(list_transform(list_zip(q.z, r.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
       FROM z q JOIN z r ON {_SELF} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance) <= 5),
lim AS (SELECT quantile_cont(m, 0.95) AS p95 FROM (SELECT avg(distance) AS m FROM dr GROUP BY vec_id)),
sig AS (SELECT v.vec_id, v.label, coalesce(any_value(m.s), 0) AS s, any_value(k.m) AS dist, any_value(lim.p95) AS p95,
               v.label IN (SELECT label FROM v WHERE NOT q AND label < 7) AS seen
        FROM v LEFT JOIN (SELECT a_id, max(similarity) AS s FROM pairs GROUP BY a_id) m ON m.a_id = v.vec_id
        JOIN (SELECT vec_id, avg(distance) AS m FROM dq GROUP BY vec_id) k ON k.vec_id = v.vec_id, lim WHERE v.q GROUP BY v.vec_id, v.label)"""
_VERDICT = "CASE WHEN s < 0.4 THEN 'out_of_domain' WHEN {n} >= 2 THEN 'out_of_domain' WHEN {n} = 1 THEN 'borderline' ELSE 'in_domain' END"
_THREE = _VERDICT.format(n="((s < 0.6)::INT + (dist > p95)::INT + (NOT seen)::INT)")
_TWO = _VERDICT.format(n="((s < 0.6)::INT + (dist > p95)::INT)")


def signals(spark, d: str) -> DataFrame:
    q, r = _scaled(spark, d)
    best = similarity.max_similarity(q, r, "vec_id", "bits")
    near = similarity.nearest_distance(q, r, "vec_id", "scaled")
    seen = r.where("label < 7").select("label").distinct().withColumn("seen", F.lit(True))
    return q.select("vec_id", "label").join(best, "vec_id").join(near, "vec_id").join(seen, "label", "left").join(F.broadcast(_limit(r)))


def _three(df: DataFrame) -> DataFrame:
    v = reliability.ad_verdict(F.col("max_similarity"), F.col("knn_distance"), F.col("p95"), F.col("seen"))
    return df.withColumn("verdict", v)


@query(f"{_SIGNALS} SELECT vec_id, {_THREE} AS verdict FROM sig")
def ad_verdict(spark, d):
    return _three(signals(spark, d)).select("vec_id", "verdict")


@query(f"{_SIGNALS} SELECT vec_id, {_TWO} AS verdict FROM sig")
def ad_verdict_2signal(spark, d):
    v = reliability.ad_verdict_without_scaffold(F.col("max_similarity"), F.col("knn_distance"), F.col("p95"))
    return signals(spark, d).select("vec_id", v.alias("verdict"))


@query(f"{_SIGNALS} SELECT {_THREE} AS verdict, count(*) AS n, round(avg((label % 2 = vec_id % 2)::INT), 6) AS accuracy FROM sig GROUP BY 1")
def ad_accuracy(spark, d):
    df = _three(signals(spark, d))
    return rounded(metrics.fraction_of(df, ["verdict"], F.col("label") % 2 == F.col("vec_id") % 2), "accuracy")


@query(f"{_SIGNALS} SELECT round(corr(s, (label % 2 = vec_id % 2)::INT::DOUBLE), 6) AS r FROM sig")
def pearson_similarity_correct(spark, d):
    right = (F.col("label") % 2 == F.col("vec_id") % 2).cast("double")
    return signals(spark, d).agg(F.round(F.corr("max_similarity", right), 6).alias("r"))


@query(f"""{_SIGNALS} SELECT vec_id, concat_ws('; ', CASE WHEN s < 0.4 THEN 'no similar reference' END, CASE WHEN s >= 0.4 AND s < 0.6 THEN 'few similar references' END,
  CASE WHEN dist > p95 THEN 'distant descriptors' END, CASE WHEN NOT seen THEN 'unseen scaffold' END) AS rationale,
  CASE {_THREE} WHEN 'borderline' THEN 'Moderate' WHEN 'in_domain' THEN CASE WHEN label > 4 THEN 'High' ELSE 'Moderate' END ELSE 'Low' END AS rating FROM sig""")
def reliability_rating(spark, d):
    df = _three(signals(spark, d))
    why = reliability.ad_rationale(F.col("max_similarity"), F.col("knn_distance"), F.col("p95"), F.col("seen"))
    return df.select("vec_id", why.alias("rationale"), reliability.reliability_rating(F.col("verdict"), F.col("label") > 4).alias("rating"))


#: Scores and truth: p = ten times the discount, y = returned.
_SCORED = "x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, round(l_discount * 10, 2) AS p, (l_returnflag = 'R')::INT AS y, l_orderkey % 10 AS g FROM lineitem)"


def scored(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", F.round(F.col("l_discount") * 10, 2).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_orderkey") % 10).alias("g"),
    )


_P = f"""WITH {_SCORED}, c AS (SELECT CASE WHEN y = 1 THEN 1 - p ELSE p END AS alpha FROM x WHERE g = 7), h AS (SELECT alpha, count(*) AS n FROM c GROUP BY alpha),
f AS (SELECT p, (SELECT coalesce(sum(n), 0) FROM h WHERE alpha >= 1 - q.p) AS ge1, (SELECT coalesce(sum(n), 0) FROM h WHERE alpha >= q.p) AS ge0, (SELECT sum(n) FROM h) AS m FROM (SELECT DISTINCT p FROM x) q),
r AS (SELECT x.*, (ge1 + 1) / (m + 1) AS p1, (ge0 + 1) / (m + 1) AS p0 FROM x JOIN f USING (p) WHERE g = 9)"""


def conformal(spark, d: str) -> DataFrame:
    x = scored(spark, d)
    alphas = x.where("g = 7").select(reliability.nonconformity(F.col("p"), F.col("y")).alias("alpha"))
    q = x.where("g = 9").withColumn("a1", 1 - F.col("p")).withColumn("a0", F.col("p"))
    one = reliability.conformal_p(q, alphas, "a1").withColumnRenamed("p_value", "p1")
    return reliability.conformal_p(one, alphas, "a0").withColumnRenamed("p_value", "p0").withColumn(
        "chosen", reliability.prediction_set(F.col("p1"), F.col("p0"))
    )


@query(f"{_P} SELECT id, round(p1, 6) AS p1, round(p0, 6) AS p0 FROM r")
def conformal_pvalues(spark, d):
    return rounded(conformal(spark, d).select("id", "p1", "p0"), "p1", "p0")


@query(f"""{_P} SELECT id, concat_ws(',', CASE WHEN p1 > (1::DOUBLE - 0.9::DOUBLE) THEN '1' END, CASE WHEN p0 > (1::DOUBLE - 0.9::DOUBLE) THEN '0' END) AS chosen,
  CASE (p1 > (1::DOUBLE - 0.9::DOUBLE))::INT + (p0 > (1::DOUBLE - 0.9::DOUBLE))::INT WHEN 1 THEN 'singleton' WHEN 2 THEN 'both' ELSE 'empty' END AS kind FROM r""")
def conformal_sets(spark, d):
    df = conformal(spark, d)
    return df.select("id", F.array_join(F.col("chosen").cast("array<string>"), ",").alias("chosen"), reliability.set_kind(F.col("chosen")).alias("kind"))


@query(f"""{_P}, s AS (SELECT *, (p1 > (1::DOUBLE - 0.9::DOUBLE))::INT + (p0 > (1::DOUBLE - 0.9::DOUBLE))::INT AS k, CASE WHEN y = 1 THEN p1 > (1::DOUBLE - 0.9::DOUBLE) ELSE p0 > (1::DOUBLE - 0.9::DOUBLE) END AS hit, ((p >= 0.5)::INT = y)::INT AS ok FROM r)
SELECT count(*) AS n, round(avg(hit::INT), 6) AS coverage, count(*) FILTER (k = 1) AS singletons, count(*) FILTER (k = 2) AS both, count(*) FILTER (k = 0) AS empty,
  round(avg(ok) FILTER (k = 1), 6) AS accuracy_singleton, round(avg(ok) FILTER (k <> 1), 6) AS accuracy_uncertain, avg(hit::INT) >= 0.85 AS covers FROM s""")
def conformal_coverage(spark, d):
    df = conformal(spark, d).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))
    return rounded(reliability.coverage(df, "chosen", "y", "predicted"), "coverage", "accuracy_singleton", "accuracy_uncertain")


@query(f"""{_P} SELECT id, (p >= 0.5)::INT AS predicted, concat_ws(',', CASE WHEN id % 5 < 2 THEN 'undefined_stereochemistry' END, CASE WHEN id % 4 = 0 THEN 'out_of_domain' END, CASE WHEN id % 4 = 1 THEN 'borderline_domain' END,
  CASE WHEN id % 4 = 2 THEN 'applicability_domain_undeterminable' END, CASE WHEN (p1 > (1::DOUBLE - 0.9::DOUBLE)) = (p0 > (1::DOUBLE - 0.9::DOUBLE)) THEN 'conformal_set_ambiguous' END, 'small_training_set') AS warnings
  FROM r WHERE l_partkey % 4 <> 0""")
def prediction_envelope(spark, d):
    at = lambda n: F.col("id") % n
    verdict = F.when(at(4) == 0, "out_of_domain").when(at(4) == 1, "borderline").when(at(4) == 2, "undeterminable").otherwise("in_domain")
    df = conformal(spark, d).withColumn("verdict", verdict)
    df = df.withColumn("status", F.when(F.col("l_partkey") % 4 == 0, "DRAFT").otherwise(flows.SERVABLE[0]))
    stereo = F.when(at(5) == 0, "undefined").when(at(5) == 1, "partially_defined").otherwise("defined")
    return flows.envelope(df, "p", "p1", "p0", "verdict", "status", stereo).select("id", "predicted", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {_SCORED}, t AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM x),
c AS (SELECT tp, fp, tn, fn, tp::DOUBLE AS a, fp::DOUBLE AS b, tn::DOUBLE AS c, fn::DOUBLE AS e FROM t)
SELECT tp, fp, tn, fn, round(a / (a + e), 6) AS sensitivity, round(c / (c + b), 6) AS specificity, round(a / (a + b), 6) AS precision, round(2 * a / (2 * a + b + e), 6) AS f1,
 round((a + c) / (a + b + c + e), 6) AS accuracy, round((a / (a + e) + c / (c + b)) / 2, 6) AS balanced_accuracy, round(b / (b + c), 6) AS fpr, round(e / (e + a), 6) AS fnr,
 round((a * c - b * e) / sqrt((a + b) * (a + e) * (c + b) * (c + e)), 6) AS mcc FROM c""")
def confusion_metrics(spark, d):
    df = metrics.confusion(scored(spark, d).withColumn("z", (F.col("p") >= 0.5).cast("int")), "y", "z")
    return rounded(df, *[c for c, t in df.dtypes if t == "double"])


_COUNTS = f"WITH {_SCORED}, s AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY p)"


@query(f"{_COUNTS}, a AS (SELECT *, pos * (coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS area FROM s) SELECT round(sum(area) / (sum(pos) * sum(neg)), 6) AS auc FROM a")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(metrics.score_counts(scored(spark, d), "p", "y")), "auc")


@query(f"{_COUNTS}, a AS (SELECT *, pos * sum(pos) OVER w / sum(pos + neg) OVER w AS gain FROM s WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(gain) / sum(pos), 6) AS average_precision FROM a")
def average_precision(spark, d):
    return rounded(metrics.average_precision(metrics.score_counts(scored(spark, d), "p", "y")), "average_precision")


@query(f"WITH {_SCORED} SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM x")
def brier(spark, d):
    return rounded(metrics.brier(scored(spark, d), "p", "y"), "brier")


_BIN = " + ".join(f"(p >= {e!r})::INT" for e in reliability.EDGES)
_BINS = f"WITH {_SCORED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS frequency FROM x GROUP BY 1)"


@query(f"{_BINS} SELECT round(sum(n * abs(confidence - frequency)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return rounded(reliability.calibration_error(reliability.calibration_bins(scored(spark, d), "p", "y")), "ece")


@query(f"{_BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(frequency, 6) AS frequency FROM b")
def calibration_bins(spark, d):
    return rounded(reliability.calibration_bins(scored(spark, d), "p", "y"), "confidence", "frequency")


@query(f"""WITH {_SCORED}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM x)
SELECT len(list_filter(q, lambda v: p > v))::INT AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS frequency FROM x, e GROUP BY 1""")
def reliability_curve(spark, d):
    return rounded(reliability.reliability_curve(scored(spark, d), "p", "y"), "confidence", "frequency")


@query(f"WITH {_SCORED} SELECT count(*) FILTER (abs(p - 0.5) < 0.05) AS strict, count(*) FILTER (p BETWEEN 0.4 AND 0.6) AS band FROM x")
def borderline_band(spark, d):
    return scored(spark, d).agg(F.count_if(F.abs(F.col("p") - 0.5) < 0.05).alias("strict"), F.count_if(F.col("p").between(0.4, 0.6)).alias("band"))


@query(f"WITH {_SCORED} SELECT l_partkey, count(*) AS n, round(avg(((p >= 0.5)::INT <> y)::INT), 6) AS error_rate FROM x GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg(((p >= 0.5)::INT <> y)::INT) DESC, n DESC, l_partkey LIMIT 10")
def worst_groups(spark, d):
    return rounded(metrics.worst_groups(scored(spark, d), "l_partkey", (F.col("p") >= 0.5).cast("int") != F.col("y")), "error_rate")


@query(f"WITH {_SCORED} SELECT id, round(abs(p - y), 6) AS error FROM x ORDER BY abs(p - y) DESC, id LIMIT 10")
def top_errors(spark, d):
    return rounded(scored(spark, d).select("id", F.abs(F.col("p") - F.col("y")).alias("error")).orderBy(F.desc("error"), "id").limit(10), "error")


@query(f"WITH {_SCORED} SELECT id, p FROM x WHERE y = 0 AND p >= 0.5 ORDER BY p DESC, id LIMIT 5")
def confident_false_positives(spark, d):
    return scored(spark, d).where("y = 0 and p >= 0.5").orderBy(F.desc("p"), "id").limit(5).select("id", "p")


@query("""WITH r AS (SELECT n_name AS name, round(sum(s_acctbal::DECIMAL(12,2))::DOUBLE, 2) AS score, n_nationkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT name AS champion, score FROM r ORDER BY score DESC, k LIMIT 1""")
def champion(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = s.groupBy(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")).agg(F.round(F.sum(F.col("s_acctbal").cast("decimal(12,2)")).cast("double"), 2).alias("score"))
    return metrics.champion(r, "name", "score", "k")


@query(f"WITH {_SCORED} SELECT g AS grp, count(*) AS n, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM x GROUP BY 1")
def accuracy_by_group(spark, d):
    return rounded(metrics.fraction_of(scored(spark, d).withColumnRenamed("g", "grp"), ["grp"], (F.col("p") >= 0.5).cast("int") == F.col("y")), "accuracy")


@query()
def bootstrap_auc(spark, d):
    return metrics.bootstrap_auc(scored(spark, d), "p", "y")


#: Groups of rows by a hash of the identifier: 0 to 6 train, 8 validate, 9 tests, 7 calibrates.
TRAIN, CALIBRATE, VALID, TEST = "g < 7", "g = 7", "g = 8", "g = 9"
#: Names of the matrix's numbers: descriptors, then bits.
DESCRIPTORS, BITS = [f"x{i}" for i in range(18)], [f"bit{i}" for i in range(46)]


def learning(spark, d: str, more: DataFrame | None = None) -> DataFrame:
    """The matrix of the vectors, written once: 18 numbers as descriptors, the signs of the rest as a
    fingerprint, three descriptors alone, and both together; more: columns by vec_id."""
    v = table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") < 5).cast("int").alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(10)).cast("int").alias("g"),
        F.slice("embedding", 1, 18).alias("d"), F.slice("embedding", 1, 3).alias("three"), F.transform(F.slice("embedding", 19, 46), lambda x: (x > 0).cast("double")).alias("f"),
    )
    v = v if more is None else v.join(more, "vec_id")
    keep = [c for c in v.columns if c not in ("d", "three", "f")]
    return fits.matrix(v, keep, {"features": ["d", "f"], "descriptors": ["d"], "fingerprint": ["f"], "few": ["three"]}, 2 * WIDTH)


def weighed(rows: DataFrame, part) -> DataFrame:
    learn = rows.where(part)
    return learn.withColumn("weight", fits.balanced(learn, "y"))


def best_forest(rows: DataFrame, also: DataFrame | None = None) -> tuple[int, int, object]:
    """Trees and depth of the forest with the largest validation area, and its model, which can score the rows of also."""
    name, found = ml.select_champion(weighed(rows, TRAIN), rows.where(VALID), "y", ml.forests("y", "weight"), also)
    return (*map(int, name.split("_")[1:]), found[name].model)


@query()
def train_champion(spark, d):
    """Every candidate's validation area, and the champion's on the test rows."""
    rows = learning(spark, d)
    name, found = ml.select_champion(weighed(rows, TRAIN), rows.where(VALID), "y", ml.candidates("y", "weight"), rows.where(TEST))
    test = fits.judged(found[name].model, rows.where(TEST), "y").auc
    table_of = [(k, float(o.auc), k == name, float(test) if k == name else None) for k, o in found.items()]
    return spark.createDataFrame(table_of, "candidate string, valid_auc double, champion boolean, test_auc double")


@query()
def recalibration(spark, d):
    rows = learning(spark, d)
    model = best_forest(rows, rows.where(f"{CALIBRATE} or {TEST}"))[2]
    cal, out = (fits.probability(model, rows.where(part)).select("vec_id", "y", "p") for part in (CALIBRATE, TEST))
    return ml.isotonic(cal, "p", "y")(ml.platt(cal, "p", "y")(out)).select("vec_id", "p", "platt", "isotonic")


@query()
def y_scramble(spark, d):
    """The champion among all candidates, fitted to ten permutations of the labels."""
    v = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(10)).alias("g"))
    rows = learning(spark, d, ml.permuted_labels(v.where(TRAIN), "vec_id", "y", 10).join(v.select("vec_id"), "vec_id", "right"))
    name = ml.select_champion(weighed(rows, TRAIN), rows.where(VALID), "y", ml.candidates("y", "weight"))[0]
    r = ml.scramble_test(rows, TRAIN, VALID, "y", 10, lambda y: ml.candidates(y, "weight")[name])
    return spark.createDataFrame([(name, *map(float, r[:5]), bool(r.passed))], "champion string, real double, mean double, sd double, least double, most double, passed boolean")


@query()
def feature_importance(spark, d):
    """The ten most important numbers of the selected forest."""
    return ml.importances(best_forest(learning(spark, d))[2], DESCRIPTORS + BITS, spark).limit(10)


@query("SELECT count(*) AS n, max(CASE WHEN quality = maj THEN 1.0 ELSE 0.0 END)::DOUBLE AS best, round(avg((quality = maj)::INT), 6) AS accuracy FROM labels, (SELECT (2 * sum(quality) >= count(*))::INT AS maj FROM labels)")
def majority_baseline(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    right = (F.col("quality") == ml.majority_baseline(labels, "quality")).cast("double")
    return labels.agg(F.count(F.lit(1)).alias("n"), F.max(right).alias("best"), F.round(F.avg(right), 6).alias("accuracy"))
