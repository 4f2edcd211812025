"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidates of every kind are found with their code point offsets: split() gives what lies between
the matches, and running sums of both lengths give the offsets. The SHA-256 of each candidate's value
is counted over the distinct owners and repositories of the whole corpus: what many of them hold is
a widely copied example, what few hold looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, salted_lookup

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run is one match, so the shortest accepted length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGNED = 6
#: From so many distinct owners, or repositories, a value counts as a widely copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 6
KINDS = ("assign", "access", "hex", "opaque")
_SALTS = 64


def _hits(text: Column, rank: int, pattern: str, value: Column | None = None) -> Column:
    """array<struct<rank, pos, gap, len, value>>: gap is the length from the last match to this."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
    group = 2 if rank == 0 else 0
    hits = F.zip_with(
        between,
        found,
        lambda gap, hit: F.struct(
            F.length(gap).alias("gap"),
            F.length(hit).alias("len"),
            (F.regexp_extract(hit, pattern, group) if group else hit).alias("value"),
        ),
    )
    hits = F.transform(
        hits,
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("pos"), x["gap"].alias("gap"), x["len"].alias("len"), x["value"].alias("value")
        ),
    )
    none = F.array().cast("array<struct<rank:int,pos:int,gap:int,len:int,value:string>>")
    return F.when(text.rlike(pattern), hits).otherwise(none)


def candidates(
    df: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column
) -> tuple[DataFrame, DataFrame]:
    """All rows (seq, doc_id), and one row per accepted candidate with its offsets and value hash."""
    text = F.col("_text")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("_seq"),
        owner.cast("string").alias("_owner"),
        repository.cast("string").alias("_repository"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).select(
        "doc_id", "_seq", "_owner", "_repository",
        F.concat(_hits(text, 0, ASSIGN), _hits(text, 1, ACCESS), _hits(text, 2, HEX), _hits(text, 3, OPAQUE)).alias("_hits"),
    )
    # The values themselves don't leave the scan.
    rows = rows.withColumn(
        "_hits",
        F.transform(
            "_hits",
            lambda x: F.struct(
                x["rank"].alias("rank"), x["pos"].alias("pos"), x["gap"].alias("gap"), x["len"].alias("len"),
                F.sha2(x["value"], 256).alias("hash"),
                F.when(x["rank"] == 0, F.length(x["value"]) >= MIN_ASSIGNED)
                .when(x["rank"] == 3, x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]"))
                .otherwise(True)
                .alias("ok"),
            ),
        ),
    )
    rows = materialize(rows, "candidates")
    order = Window.partitionBy("_seq", "rank").orderBy("pos")
    reach = F.sum(F.col("gap") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = (
        rows.select("doc_id", "_seq", "_owner", "_repository", F.explode("_hits").alias("h"))
        .select("doc_id", "_seq", "_owner", "_repository", "h.*")
        .withColumn("end", reach)
        .where("ok")
        .withColumn("start", F.col("end") - F.col("len"))
        .drop("gap", "len", "pos", "ok")
    )
    return rows, spans


def ownership(spans: DataFrame) -> DataFrame:
    """Per value hash: occurrences, distinct owners, distinct repositories, verdict.

    A null owner or repository counts as one of its own. Distinct pairs are made before the count,
    so a value held by a third of all rows shrinks to its pairs in the first aggregate.
    """
    pairs = spans.groupBy("hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("_n"))
    owners = pairs.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("_repositories"), F.sum("_n").alias("_n"))
    return owners.groupBy("hash").agg(
        F.sum("_n").alias("occurrences"),
        F.count(F.lit(1)).alias("owners"),
        F.sum("_repositories").alias("repositories"),
    ).withColumn(
        "verdict",
        F.when((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES), "example").otherwise("live"),
    )


def secret_spans(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every row of df as (doc_id, _seq), and its spans with owners and verdict.

    A null or empty text has no spans. Opaque candidates (long mixed tokens of no known form) are
    kept only where their value looks live and no span of a known form overlaps them.
    """
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    rows, spans = candidates(df, id_col, text_col, owner, repository)
    spans = spans.withColumn("_salt", F.pmod("_seq", F.lit(_SALTS)))
    judged = salted_lookup(spans, ["hash"], ownership(spans), "_salt")
    # Spans of a known form come first by start; an opaque one that begins before their furthest end,
    # or reaches past the next one's start, overlaps.
    known = F.col("rank") < 3
    by_start = Window.partitionBy("_seq").orderBy("start", "rank")
    reach = F.max(F.when(known, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(known, F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    overlaps = (F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
    judged = judged.withColumn("_overlaps", overlaps)
    spans = judged.where(known | (~F.col("_overlaps") & (F.col("verdict") == "live")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    return rows.select("doc_id", "_seq"), spans.select(
        "doc_id", "_seq", "rank", kind.alias("kind"), "start", "end", "hash", "occurrences", "owners", "repositories", "verdict"
    )


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner=None, repository=None) -> DataFrame:
    """Per row of df: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Rows that repeat an identifier, or are alike throughout, are rows of their own. Spans that start together are in
    the order of their kinds. A null owner, or repository, is one of its own. Columns other than those named aren't
    read, so theirs can't clash. An empty table gives no rows.
    """
    rows, spans = secret_spans(df, id_col, text_col, owner, repository)
    item = F.struct("start", "rank", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("at"))
    joined = lambda items: F.array_join(F.transform(F.array_sort(items), lambda x: x["at"]), ",")
    known = F.col("rank") < 3
    per_row = spans.groupBy("_seq").agg(
        *[F.count_if(F.col("rank") == i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(joined(F.collect_list(F.when(known, item))), 256).alias("base_sha256"),
        joined(F.collect_list(item)).alias("spans"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
    )
    out = rows.join(per_row, "_seq", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        zero("n_live"), zero("n_example"),
    )
