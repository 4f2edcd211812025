"""Merkle manifest, filter audit and quality model against plain Python on tables full of edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, merkle, quality_model

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _g string, _range long, part string, _mask int, tie int"


def frame(spark, rows, parts=3):
    """rows of (doc_id, source, lang, n_chars, text); extra columns clash with names used inside."""
    return spark.createDataFrame([(*r, "g", 5, "p", 9, 1) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, f"s{i % 3}", "hot" if i % 3 else rng.choice(["de", "é", "z", "_g", ""]), i * 7, " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 160)))) for i in range(140)]
    out += [(1000 + i, "s", "hot", 5, "a copy that many rows hold") for i in range(40)]
    out += [(7, "s", "hot", 1, "another seven"), (9, "t", "hot", 2, "twice"), (9, "t", "hot", 2, "twice"), (None, None, None, None, None), (None, "s", None, 3, ""), (None, "s", None, 3, "")]
    out += [(21, "s", None, None, "tampering leaves nulls"), (300, None, "alone", 2**62, "Ü" * 50), (301, "s", "hot", 4, "LOUD WORDS # " * 90), (302, "s", "hot", 4, "many words " * 30_000), (303, "s", "hot", 4, None)]
    return out


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_path(levels, at, arity):
    for level in levels[:-1]:
        run = at // arity * arity
        yield level[run:at], level[at + 1 : run + arity]
        at //= arity


def plain_manifest(rows, arity):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: plain_levels([leaf(r) for r in groups[g]], arity) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            path = [*plain_path(trees[g], at, arity), *plain_path(top, k, arity)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for before, after in path:
                folded = h(*before, folded, *after)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(x for b, a in path for x in (*b, *a))), folded, folded == top[-1][0]))
    return out


def audited(df, arity=2):
    c = {k: F.col(k) for k in merkle.FIELDS}
    more = c | {"n_chars": c["n_chars"].cast("decimal(20,0)") + 1}
    hit = (F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0) & c["n_chars"].isNotNull()
    return merkle.audited(df, merkle.leaf_hash(*c.values()), F.when(hit, merkle.leaf_hash(*more.values())), arity=arity)


@pytest.mark.parametrize("arity,range_rows,fan_in", [(2, 50_000, 16), (2, 9, 2), (3, 5, 2), (5, 30, 3)])
def test_manifest_as_in_plain_python(spark, rows, monkeypatch, arity, range_rows, fan_in):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(merkle, "FAN_IN", fan_in)
    got = [tuple(r) for r in audited(frame(spark, rows), arity).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_manifest(rows, arity), key=key)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_one_row_and_of_none(spark, rows):
    one = rows[:1]
    assert [tuple(r) for r in audited(frame(spark, one)).collect()] == plain_manifest(one, 2)
    assert audited(frame(spark, [])).count() == 0
    assert audited(frame(spark, one)).first().proof_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("arity,n", [(2, 1), (2, 13), (3, 27), (4, 29)])
def test_merging_is_associative(arity, n):
    """Any order of merging any fragments ends in the same root."""
    rng = random.Random(n)
    leaves = [h(str(i)) for i in range(n)]
    for _ in range(20):
        parts = [{(0, i): leaves[i]} for i in range(n)]
        while len(parts) > 1:
            a = parts.pop(rng.randrange(len(parts)))
            b = parts.pop(rng.randrange(len(parts)))
            parts.append(merkle.merged(n, a | b, arity)[0])
        assert parts == [{(merkle.depth(n, arity), 0): plain_levels(leaves, arity)[-1][0]}]


def test_a_fragment_keeps_few_nodes():
    n = 1 << 14
    waiting, _ = merkle.merged(n, {(0, i): h(str(i)) for i in range(3_001, 9_999)}, 2)
    assert len(waiting) <= 2 * 14


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, _, _, _, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, _, lang, _, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good and i is not None, i in toxic and i is not None))
    out, removed = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                n = dict.fromkeys(filter_audit.COUNTS, 0)
                for p, fails, g, x in docs:
                    if p == part:
                        first = min((k for k, f in enumerate(order, 1) if f in fails), default=9)
                        n["kept"] += first > step
                        n["removed"] += first == step
                        n["redundant"] += letter in fails and first < step
                        n["unique_fails"] += fails == {letter}
                        n["good_lost"] += first == step and g
                        n["toxic_lost"] += first == step and x
                out[part, order, step] = n
                removed[part, letter] += n["removed"]
    return {k: v | {"shapley": removed[k[0], k[1][k[2] - 1]]} for k, v in out.items()}


def test_audit_as_in_plain_python(spark, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 140, 3)] + [(1, None, 1), (1, 1, None), (1003, 0, 1), (1003, 1, 0), (None, 1, 1), (9, 1, 1), (77_777, 1, 1), (301, 1, 0)]
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in (*filter_audit.COUNTS, "shapley")} == want[r.part, r.filter_order, r.step]


def test_audit_of_empty_tables(spark, rows):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), nothing).count() == 0
    got = filter_audit.audit(frame(spark, rows[:1]), nothing).collect()
    assert len(got) == 600 and not any(r.good_lost or r.toxic_lost for r in got)


def test_no_exploded_row_is_shuffled(spark, rows):
    """What is exchanged above the replay are partial counts."""
    plan = filter_audit.audit(frame(spark, rows), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert above.rindex("Exchange hashpartitioning") < above.rindex("partial_count")


def junk(rng, kind):
    words = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(20, 200))]
    return {0: " ".join(w + "###" for w in words), 1: " ".join(words).upper() + "!!", 2: f"{words[0]} " * 80, 3: " | ".join(words)}[kind]


def test_model_tells_junk_from_prose(spark):
    rng = random.Random(2)
    texts = [junk(rng, i % 4) if i % 5 == 0 else ". ".join(" ".join(f"w{rng.randint(0, 900)}" for _ in range(12)) for _ in range(rng.randint(1, 15))) for i in range(900)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(texts)] + [(3, "s", "en", 1, texts[3]), (None, None, None, None, "plain words here"), (5_000, None, None, None, None), (5_001, "", "", 0, ""), (5_002, "s", "en", 1, "word " * 400_000)]
    # Held-out labels are all wrong: learning from them would show.
    labels = [(i, int(i % 5 > 0) ^ held(i)) for i in range(900) if i % 7] + [(2, None), (6, 0), (6, 1), (None, 1)]
    got = quality_model.quality_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id) for r in got)
    right = [r.predicted == (r.doc_id % 5 > 0) for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(right) / len(right) > 0.97
    again = quality_model.quality_scores(frame(spark, rows, 7), spark.createDataFrame(labels, "doc_id long, quality int").repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_model_without_labels_or_rows(spark, rows):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_model.quality_scores(frame(spark, rows), nothing).collect()
    assert len(got) == len(rows) and {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    one = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert {r.score for r in quality_model.quality_scores(frame(spark, rows), one).collect()} == {0.5}
    assert quality_model.quality_scores(frame(spark, []), one).count() == 0


def test_tables_add_up_and_find_an_interaction():
    rng = np.random.default_rng(4)
    a, b, c = rng.random((3, 4_000))
    y = ((a > 0.5) ^ (b > 0.5)).astype(float)
    edges = [np.arange(1, 16) / 16] * 3
    model = quality_model.fit([a, b, c], y, edges, np.arange(4_000) % 6 == 0)
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)
    p = model.score([a, b, c])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95
    for k in range(0, 4_000, 501):  # one row at a time, by hand
        z = model.intercept + sum(t[sum(e <= x[k])] for t, e, x in zip(model.tables, model.edges, (a, b, c)))
        z += sum(t[sum(model.coarse[i] <= (a, b, c)[i][k]), sum(model.coarse[j] <= (a, b, c)[j][k])] for i, j, t in model.pairs)
        assert np.isclose(p[k], 1 / (1 + np.exp(-z)))


def test_tree_is_the_best_step():
    """Against all ways of cutting twelve bins in two."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        g, w = rng.normal(size=12), rng.random(12) * 3 + 1
        gains = {at: g[:at].sum() ** 2 / (w[:at].sum() + 1) + g[at:].sum() ** 2 / (w[at:].sum() + 1) - g.sum() ** 2 / (w.sum() + 1) for at in range(1, 12) if w[:at].sum() >= 2 and w[at:].sum() >= 2}
        gain, at = quality_model.cut(g, w)
        assert at == (max(gains, key=gains.get) if max(gains.values()) > 0 else 0) and np.isclose(gain, max(0, max(gains.values())))
        assert len(np.unique(quality_model.tree(g, w, 4))) <= 4
