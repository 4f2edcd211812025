"""Neighbour search by bands and pivots against all pairs, and what it doesn't read."""

import random

import numpy as np
import pytest

from lodestone.operators import similarity


def jaccard(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0


@pytest.fixture(scope="module")
def sets():
    """Vectors of 1 to 60 bits, ten with a close partner, an empty one."""
    rng = random.Random(9)
    out = {i: sorted(rng.sample(range(200), rng.randint(1, 60))) for i in range(120)}
    out |= {200 + i: sorted({*out[i], 199}) for i in range(10)}
    return out | {300: [], 301: list(range(200)), 302: list(range(200))}


@pytest.mark.parametrize("block,k", [(20_000, 3), (5, 4)])
def test_neighbours_are_those_of_all_pairs(spark, sets, folder, monkeypatch, block, k):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    df = spark.createDataFrame([*sets.items(), (900, None)], "id long, bits array<int>")
    q, r = df.where("id % 2 = 0"), df.where("id % 2 = 1 or id = 300 or id = 900")
    index = similarity.index_bits(r, "id", "bits", f"{folder}/index")
    asked = []
    got = {}
    for x in similarity.neighbours(q, index, "id", "bits", k, asked).collect():
        got.setdefault(x.id, []).append((x.rank, x.neighbour_id, x.similarity))
    refs = [i for i in sets if i % 2 or i == 300]
    for i in (i for i in sets if i % 2 == 0):
        want = sorted((-jaccard(sets[i], sets[j]), j) for j in refs)[:k]
        assert sorted(got[i]) == [(n, j, pytest.approx(-s)) for n, (s, j) in enumerate(want, 1)]
    assert 900 not in got
    pairs = sum(a.count() for a in asked)
    if block == 5:
        assert len(index.bands) > 8 and pairs < len(got) * len(index.bands)


def test_bands_beyond_the_bound_are_not_read(spark, folder, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 1)
    refs = spark.createDataFrame([(n, list(range(n))) for n in range(1, 65)], "id long, bits array<int>")
    index = similarity.index_bits(refs, "id", "bits", f"{folder}/index")
    asked = []
    best = similarity.neighbours(spark.createDataFrame([(1, list(range(40)))], "id long, bits array<int>"), index, "id", "bits", 2, asked).collect()
    assert [(r.rank, r.neighbour_id) for r in sorted(best)] == [(1, 40), (2, 41)] and len(index.bands) == 64
    # The best so far is 40/41 after the first bands to each side: nothing further can reach it.
    assert sorted(r._cell for a in asked for r in a.collect()) == [38, 39, 40]


def test_join_pairs_meet_once_and_only_within_the_factor(spark, sets, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 6)
    df = spark.createDataFrame(list(sets.items()), "id long, bits array<int>")
    got = sorted(tuple(r) for r in similarity.tanimoto_join(df, df, "id", "id", "bits", 0.6).collect())
    want = sorted((i, j, jaccard(x, y)) for i, x in sets.items() for j, y in sets.items() if x and y and jaccard(x, y) >= 0.6)
    assert got == want
    assert similarity.tanimoto_join(df.limit(0), df, "id", "id", "bits", 0.6).count() == similarity.tanimoto_join(df, df.limit(0), "id", "id", "bits", 0.6).count() == 0


def test_distant_cells_are_not_asked(spark, monkeypatch):
    """Twelve clusters far apart: a query's neighbours are in its own, and others' rows don't meet it."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(20, 3)) + 1_000 * c for c in range(12)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    met = []
    real = similarity.in_cells

    def watched(asking, answering, meet, schema):
        met.append(asking.count())
        return real(asking, answering, meet, schema)

    monkeypatch.setattr(similarity, "in_cells", watched)
    got = {r.id: r.knn_distance for r in similarity.nearest_distance(df, df, "id", "v", 3, exclude_self=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == pytest.approx(np.sort(d[i])[:3].mean(), abs=1e-4) for i in range(240))
    assert sum(met) < 240 * 8  # of 24 cells


def test_collisions_are_of_whole_vectors(spark):
    q = spark.createDataFrame([(1, [0, 3, 99]), (2, [0, 3]), (3, []), (4, [0, 3, 99])], "id long, bits array<int>")
    r = spark.createDataFrame([(9, [0, 3, 99]), (8, [0, 3, 98]), (7, [0, 3, 99])], "id long, bits array<int>")
    assert tuple(similarity.exact_collisions(q, r, "bits").first()) == (4, 2)


def test_collisions_name_each_query_and_compare_whole_numbers(spark, folder, monkeypatch):
    import duckdb

    from lodestone import catalog

    rows = {1: [1.0, -2.0], 2: [3.0, -4.0], 3: [1.0, -2.0], 4: [3.0, -4.0], 6: [9.0, -9.0], 9: [-1.0, 2.0], 7: [0.0, 1.0], 12: [-0.0, 1.0], 15: None, 16: None, 18: [None, 1.0], 19: [None, 1.0], 21: [], 22: [1.0]}
    rows |= {300 + 3 * i: [3.0, -4.0] for i in range(40)} | {600 + 3 * i: [0.0 if i % 2 else -0.0, 1.0] for i in range(20)}  # common vectors
    spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    found, sql = catalog.load()
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    got = {r.vec_id: (r.same_vector, r.same_bits) for r in found["exact_vector_collisions"](spark, folder).collect()}
    want = {3: (1, 3), 6: (0, 3), 9: (0, 1), 12: (1, 1), 15: (0, 0), 18: (1, 1), 21: (0, 0)}
    want |= {300 + 3 * i: (2, 3) for i in range(40)} | {600 + 3 * i: (1, 1) for i in range(20)}
    assert got == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert {i: (v, b) for i, v, b in db.execute(sql["exact_vector_collisions"]).fetchall()} == want
    colliding = db.execute("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 AND embedding IN (SELECT embedding FROM embeddings WHERE vec_id % 3 <> 0)")
    assert {i for (i,) in colliding.fetchall()} == {i for i, (n, _) in got.items() if n}


def test_best_of_a_block_without_putting_all_in_order(monkeypatch):
    """Ties go to the smallest identifier, and the full order of a block is never made."""
    import pandas as pd

    rng = np.random.default_rng(5)
    held = lambda n, o: pd.DataFrame({"_id": rng.permutation(n) + o, "_bits": [np.flatnonzero(x) for x in rng.random((n, 9)) < 0.3]})
    a, b = held(60, 0), held(90, 1_000)
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) or len(y) else 0.0
    want = {i: sorted((-alike(x, y), j) for j, y in zip(b["_id"], b["_bits"])) for i, x in zip(a["_id"], a["_bits"])}
    monkeypatch.setattr(np, "argsort", None)
    for k, rows, columns in ((1, 7, 4), (1, 256, 2_048), (4, 7, 4), (200, 7, 4)):
        got = similarity._most_similar(a, b, k, rows, columns)
        assert all([(-x["similarity"], x["neighbour_id"]) for x in row] == want[i][:k] for i, row in zip(a["_id"], got))
    wide = pd.DataFrame({"_id": [1, 2], "_bits": [list(range(1_500)), list(range(1_499))]})  # quotients a float can't tell from each other
    assert similarity._most_similar(wide.tail(1), wide, 1)[0][0]["neighbour_id"] == 2


@pytest.mark.parametrize("scale, middle", [(1.0, 0.0), (1.0, 1e4), (1e20, 0.0), (1e-20, 0.0)])
def test_nearest_is_exact_where_floats_are_not(scale, middle):
    """Nearest distances as from all differences, with ties, few rows, limits, and numbers that aren't finite."""
    rng = np.random.default_rng(9)
    x, y = ((rng.normal(size=(n, 5)) + middle) * scale for n in (40, 70))
    y[:40] = x + rng.normal(size=(40, 5)) * 1e-6 * scale  # much nearer than a product of floats tells
    y[60], y[61], x[3] = y[20], np.nan, np.inf
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    ids, others = np.arange(40), np.arange(70)
    for apart in (False, True):
        free = np.where(apart & (ids[:, None] == others), np.inf, d)
        for k, limit in ((3, np.full(40, np.inf)), (3, np.nanmedian(d, axis=1)), (100, np.full(40, np.inf))):
            got = similarity._nearest(x, y, k, limit, *((ids, others) if apart else ()), rows=7, columns=9)
            for i in range(40):
                want = [] if i == 3 else sorted(v for v in free[i] if np.isfinite(v) and v <= limit[i])[:k]
                assert got[i].tolist() == pytest.approx(want, rel=1e-7)
    assert [len(r) for r in similarity._nearest(x, y[61:62], 2, np.full(40, np.inf))] == [0] * 40


SIGNALS = [
    "reliability_rating",
    "ad_verdict",
    "ad_verdict_2signal",
    "pearson_similarity_correct",
    "ad_accuracy",
]


@pytest.mark.parametrize("name", SIGNALS)
def test_signals_met_in_blocks_equal_their_sql(spark, monkeypatch, name):
    import os

    import duckdb

    from lodestone import catalog

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no common tables")
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 120)
    found, sql = catalog.load()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert sorted(map(str, map(tuple, found[name](spark, folder).collect()))) == sorted(map(str, db.execute(sql[name]).fetchall()))
