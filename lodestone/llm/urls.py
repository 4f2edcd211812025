"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

DataFrame operations and pyspark.ml only. URLs that a rule judges are the labelled ones; the trees
learn from a bounded sample of them and judge the others.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_sample, materialize

#: (verdict, host, path): fits the host and its subdomains where the path starts with this one.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The trees are fitted to at most so many labelled URLs, those with the smallest hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 15, 4, 11
#: A suffix's share of blocked URLs is drawn to the mean as if by so many more URLs.
SMOOTHING = 10.0
FEATURES = (
    "length", "host_length", "path_length", "host_depth", "path_depth", "digits", "digit_ratio", "hyphens",
    "entropy", "parameters", "has_fragment", "has_query", "is_https", "last_is_digit", "suffix_rate", "suffix_share",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<n, rule, verdict> of the longest rule that fits, else null. Rules stand in the plan:
    they are a parameter of at most a few thousand entries."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    table = F.array(
        *[
            F.struct(
                F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"),
                F.lit(h).alias("host"), F.lit("." + h).alias("below"), F.lit(p).alias("path"),
            )
            for v, h, p in rules
        ]
    )
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | F.endswith(host, r["below"])) & F.startswith(path, r["path"]),
    )
    return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.length(url)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    chars = F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.greatest(F.size(chars), F.lit(1))
    entropy = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, b: a + b
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)/?$", 1)
    return {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": F.size(F.split(host, r"\.")),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digits": digits,
        "digit_ratio": digits / F.greatest(n, F.lit(1)),
        "hyphens": n - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "has_query": F.contains(url, F.lit("?")).cast("int"),
        "is_https": F.startswith(url, F.lit("https")).cast("int"),
        "last_is_digit": last.rlike("^[0-9]+$").cast("int"),
    }


def judged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row of df: page_id, host, path, rule, verdict, score.

    A null URL counts as empty; its host and path are empty. Where no rule fits, the trees' score
    (probability of block) decides at 0.5. With no labelled URL at all the verdict is allow and the
    score 0; with labels of one kind that kind is the verdict. An empty table gives no rows. Repeated identifiers
    and URLs are rows of their own, and URLs alike have one verdict. Other columns aren't read, so theirs can't
    clash.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("page_id"), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_hit", hit).select(
        "page_id", "_url", "host", "path", F.col("_hit.rule").alias("rule"), F.col("_hit.verdict").alias("_verdict"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("_suffix"),
    )
    features = lexical(F.col("_url"), F.col("host"), F.col("path"))
    rows = rows.select("*", *[c.cast("double").alias(f"_{k}") for k, c in features.items()])
    labelled = rows.where(F.col("_verdict").isNotNull()).withColumn("_label", (F.col("_verdict") == "block").cast("double"))
    sample = hash_sample(labelled, TRAIN_ROWS, "_url", "page_id")
    # Bounded by TRAIN_ROWS, so one partition holds it and every sum has one order.
    sample = materialize(sample.coalesce(1), "labelled_urls")
    n, blocked = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    if not n or blocked in (0, n):
        score = F.lit(1.0 if n and blocked else 0.0)
        out = rows.withColumn("score", F.when(F.col("_verdict") == "block", 1.0).when(F.col("_verdict") == "allow", 0.0).otherwise(score))
    else:
        # At most TRAIN_ROWS suffixes: small enough to broadcast by construction.
        suffixes = sample.groupBy("_suffix").agg(
            ((F.sum("_label") + SMOOTHING * blocked / n) / (F.count(F.lit(1)) + SMOOTHING)).alias("_suffix_rate"),
            (F.count(F.lit(1)) / F.lit(float(n))).alias("_suffix_share"),
        )
        ready = lambda d: VectorAssembler(
            inputCols=[f"_{k}" for k in FEATURES], outputCol="_features"
        ).transform(
            d.join(F.broadcast(suffixes), "_suffix", "left").fillna({"_suffix_rate": blocked / n, "_suffix_share": 0.0})
        )
        train = ready(sample.coalesce(1))
        model = GBTClassifier(
            featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
            predictionCol="_p",
        ).fit(train)
        out = model.transform(ready(rows)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
