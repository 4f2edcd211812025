"""The numbered corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import scratch_path
    from lodestone.llm.token_files import read_digests, write_tokens

    return read_digests(write_tokens(documents(spark, sf_dir), scratch_path(spark, "token_files")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.exact_dedup import duplicate_groups

    return duplicate_groups(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mixture

    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii import pseudonym_report

    return pseudonym_report(documents(spark, sf_dir), key="lodestone")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import secret_report

    repository = F.concat_ws("/", "source", "lang")
    return secret_report(documents(spark, sf_dir), owner=F.col("source"), repository=repository)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import quality_report

    return quality_report(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.shingle_join import similar_components

    return similar_components(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.urls import judged

    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir)).drop("ids")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.merkle import audited, leaf_hash

    doc, source, lang, chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    hit = F.crc32(doc.cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit & chars.isNotNull(), leaf_hash(doc, source, lang, chars.cast("decimal(20,0)") + 1, text))
    return audited(documents(spark, sf_dir), leaf_hash(doc, source, lang, chars, text), tampered)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.filter_audit import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality_model import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


SQL_EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM h
"""


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL_SOURCE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('20240229:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY source
), r AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, source)
), t AS (
  SELECT source, source_size, (CASE WHEN ratio <= level THEN cap ELSE w * (SELECT level FROM l WHERE ratio > level ORDER BY ratio LIMIT 1) END)::DOUBLE AS target FROM l
), b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE
  budget // source_size * size + least(size, greatest(0, budget % source_size - start)) END)::BIGINT AS taken FROM b
"""

SQL_SECRET_SCAN = r"""
WITH d AS (SELECT doc_id, source AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
p(rank, kind, pat) AS (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'opaque', '[A-Za-z0-9+/_=-]{20,}')),
m AS (SELECT doc_id, owner, repo, rank, kind, regexp_extract_all(t, pat) AS hits, string_split_regex(t, pat) AS gaps FROM d, p WHERE regexp_matches(t, pat)),
u AS (SELECT doc_id, owner, repo, rank, kind, unnest(range(1, len(hits) + 1)) AS pos, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM m),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY pos) AS fin,
        CASE rank WHEN 0 THEN regexp_extract(hit, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) ELSE hit END AS value FROM u),
s AS (SELECT doc_id, owner, repo, rank, kind, (fin - length(hit))::BIGINT AS start, fin::BIGINT AS fin, value FROM e
      WHERE CASE rank WHEN 0 THEN length(value) >= 6 WHEN 1 THEN length(value) >= 20 WHEN 2 THEN length(value) >= 24
            ELSE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') END),
v AS (SELECT value, CASE WHEN count(DISTINCT row(owner)) >= 3 OR count(DISTINCT row(owner, repo)) >= 6 THEN 'example' ELSE 'live' END AS verdict FROM s GROUP BY value),
k AS (SELECT s.*, verdict, kind || ':' || start || ':' || fin AS lbl FROM s JOIN v USING (value)
      WHERE rank < 3 OR verdict = 'live' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.rank < 3 AND b.start < s.fin AND b.fin > s.start)),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        coalesce(string_agg(lbl, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(lbl, ',' ORDER BY start, rank) AS spans,
        count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (doc_id)
"""

SQL_QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
x AS (SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, range(0, 5) AS s(o) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_stutters FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d) WHERE w[i] = w[i - 1] GROUP BY doc_id),
m AS (SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutters, 0) AS n_stutters, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * marks > n_words OR 2 * upper > letters OR 2 * n_dup_lines > n_lines OR 5 * n_stutters > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM f
"""

SQL_SHINGLE_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc, other) AS (SELECT a, b FROM p UNION SELECT r.doc, p.b FROM reach r JOIN p ON r.other = p.a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(other) FROM reach WHERE doc = doc_id), doc_id)) AS component_id FROM s
"""


SQL_MERKLE_MANIFEST = r"""
WITH RECURSIVE e AS (
  SELECT doc_id, lang, CASE WHEN n_chars IS NOT NULL THEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) END AS crc_not,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || chars || tail) AS leaf, CASE WHEN xor(crc_not, 4294967295) % 7 = 0 THEN sha256(head || more || tail) END AS tampered FROM e)
), t(lang, lv, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM l UNION ALL SELECT lang, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lv, i // 2, n
), g AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, n, h) AS (
  SELECT 0, i, n, subroot FROM g UNION ALL SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 2, n
), p AS (
  SELECT l.lang, l.i, list(CASE WHEN s.h IS NULL THEN '-' WHEN (l.i >> z.lv) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY z.lv) AS path
  FROM l JOIN (SELECT DISTINCT lang, lv FROM t WHERE n > 1) z ON z.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lv = z.lv AND s.i = xor(l.i >> z.lv, 1) GROUP BY l.lang, l.i
), q AS (
  SELECT g.i, list(CASE WHEN s.h IS NULL THEN '-' WHEN (g.i >> z.lv) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY z.lv) AS path
  FROM g, (SELECT DISTINCT lv FROM u WHERE n > 1) z LEFT JOIN u s ON s.lv = z.lv AND s.i = xor(g.i >> z.lv, 1) GROUP BY g.i
), a AS (
  SELECT l.doc_id, l.leaf, l.tampered, g.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(p.path, []) || coalesce(q.path, []) AS path
  FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i LEFT JOIN q ON q.i = g.i
), f AS (
  SELECT *, list_reduce(list_prepend(coalesce(tampered, leaf), path), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root FROM a
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

SQL_FILTER_AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
y AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) = 1 AS good, coalesce(max((toxic = 1)::INT), 0) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails FROM w JOIN c USING (t) LEFT JOIN y ON y.doc_id = w.doc_id),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
r AS (SELECT part, good, toxic, fails, filter_order, coalesce(list_min(list_filter(range(1, 6), lambda k: contains(fails, filter_order[k]))), 6) AS first FROM m, o),
s AS (SELECT r.*, k::INT AS step, filter_order[k] AS f FROM r, range(1, 6) AS s(k)),
z AS (SELECT part, filter_order, step, f, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (contains(fails, f) AND first < step) AS redundant,
        count(*) FILTER (fails = f) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM z
"""


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_pseudonyms": op4_pseudonyms,
        "op5_secret_scan": op5_secret_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_toxicity": op7_toxicity,
        "op8_shingle_join": op8_shingle_join,
        "op9_url_filter": op9_url_filter,
        "op10_packing": op10_packing,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_filter_audit": op12_filter_audit,
        "op13_quality_model": op13_quality_model,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": SQL_EXACT_DEDUP,
        "op3_source_mixing": SQL_SOURCE_MIXING,
        "op5_secret_scan": SQL_SECRET_SCAN,
        "op6_quality_rules": SQL_QUALITY_RULES,
        "op8_shingle_join": SQL_SHINGLE_JOIN,
        "op11_merkle_manifest": SQL_MERKLE_MANIFEST,
        "op12_filter_audit": SQL_FILTER_AUDIT,
    }
