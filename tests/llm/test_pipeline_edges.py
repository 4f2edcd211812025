"""Pipeline stages on null and repeated identifiers and on empty tables; the URL trees on rows held out of their labels."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import urls

SPACE = re.compile(r"[\x20\x09-\x0D]+")
PAGES = "/root/testdata/sf0.1/pages.parquet"


def shingle_set(text):
    w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def last_none(i):
    return (i is None, i or 0)


def plain_stages(rows):
    """Rows after quality, exact and near duplicates. Every text has 10 to 200 words that don't repeat."""
    rows = [r for r in rows if r[1] and len(r[1].split()) >= 10]
    equal = {}
    for i, t in rows:
        equal.setdefault(SPACE.sub(" ", t), []).append((i, t))
    left = [min(g, key=lambda r: last_none(r[0])) for g in equal.values()]
    sets, group = [shingle_set(t) for _, t in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [min((left[k] for k in range(len(left)) if group[k] == g), key=lambda r: last_none(r[0])) for g in set(group)]


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(41)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "sk", "lo", "ma")]
    prose = lambda: " ".join(rng.sample(words, 60))
    base, second, third = prose(), prose(), prose()
    edited = lambda t, at, new: " ".join(new if k == at else w for k, w in enumerate(t.split()))
    rows = [(None, base), (7, base), (None, edited(base, 30, "edited")), (9, edited(base, 2, "other"))]  # 7 stays
    rows += [(None, second), (None, second.replace(" ", "\n", 3)), (None, edited(second, 59, "end"))]  # one null identifier stays
    rows += [(3, third), (3, third), (3, prose()), (3, prose()), (4, prose())]  # one identifier, several texts
    rows += [(None, None), (5, None), (6, ""), (None, " \n "), (8, "too few words"), (None, prose())]
    return rows


def test_stages_on_null_and_repeated_identifiers(spark, edge_rows):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, label long"
    df = spark.createDataFrame([(i, t, None, None if k % 3 else "s", None, "x", k) for k, (i, t) in enumerate(edge_rows)], schema).repartition(4)
    docs = df
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), df.schema)
        assert docs.columns == df.columns, name
    want, got = plain_stages(edge_rows), [(r.doc_id, r.text) for r in docs.collect()]
    plain = lambda rows: Counter((i, SPACE.sub(" ", t)) for i, t in rows)
    ids = lambda rows: sorted((i for i, _ in rows), key=last_none)
    assert ids(got) == ids(want)
    assert {k: n for k, n in plain(got).items() if k[0] is not None} == {k: n for k, n in plain(want).items() if k[0] is not None}
    assert all(r in [(i, SPACE.sub(" ", t)) for i, t in edge_rows if t] for r in plain(got))
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    rows = mixed.collect()
    assert mixed.columns == df.columns and {(r.doc_id, r.label) for r in rows} <= {(r.doc_id, r.label) for r in docs.collect()}
    assert all(n <= 2 for n in Counter(r.label for r in rows).values())


def test_pipeline_of_an_empty_table(spark, folder):
    import corpus_pipeline

    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    rejected = spark.createDataFrame([(1, None, "en", "s", 0), (None, "two words", "en", None, 9)], df.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rejected = spark.createDataFrame(stage(spark, rejected, "").collect(), df.schema)
        assert rejected.count() == 0


def area(pairs):
    """Share of (blocked, allowed) pairs in which the blocked one has the higher score; ties count half."""
    scores, below, total = sorted(pairs), 0.0, 0
    yes, no = sum(y for _, y in scores), sum(1 - y for _, y in scores)
    k = 0
    while k < len(scores):
        tied = [y for s, y in scores[k:] if s == scores[k][0]]
        total += sum(tied) * (below + (len(tied) - sum(tied)) / 2)
        below += len(tied) - sum(tied)
        k += len(tied)
    return total / (yes * no)


def held_out_scores(spark, path):
    """(score, blocked) of pages that the production rules judge and that the same rules, told of numbers that begin
    with 1 to 7 only, leave to the trees."""
    whole = [("allow", "org", "/de/"), ("allow", "org", "/fr/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    known = tuple((v, h, f"{p}{k}") for v, h, p in whole for k in range(1, 8))
    pages = spark.read.parquet(path)
    scores = urls.judged(pages, rules=known).where("rule is null").select("page_id", "score")
    truth = urls.judged(pages, rules=tuple(whole)).where("rule is not null").select("page_id", (F.col("verdict") == "block").cast("int").alias("blocked"))
    return [(r.score, r.blocked) for r in scores.join(truth, "page_id").collect()]


def test_url_trees_on_held_out_pages(spark):
    pairs = held_out_scores(spark, PAGES)
    assert len(pairs) > 100 and 0 < sum(y for _, y in pairs) < len(pairs)
    assert area(pairs) > 0.6
