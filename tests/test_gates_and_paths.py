"""Gates that stop, rules that rows break, and shortest typed paths against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import scalars
from lodestone.operators import constraints, gates, governance

FOLDER = "/root/testdata/sf0.01"


def test_a_stop_leaves_a_quarantine_and_starts_nothing(spark, folder):
    df = spark.createDataFrame([(i, i - 3, None if i == 9 else i) for i in range(20)] + [(7, 4, 1)], "id int, v int, w int")
    gate = gates.Gate("one", {"positive": F.col("v") > 0, "small": F.col("w") < 19}, lambda x: constraints.repeated(x, ["id"], "unique"))
    with pytest.raises(gates.GateStopped) as stop:
        gates.passed(df, "id", gate, f"{folder}/one")
    assert stop.value.counts == {"rows": 21, "quarantined": 7, "positive": 4, "small": 1} and stop.value.path == f"{folder}/one"
    held = sorted((r.id, tuple(r.broken)) for r in gates.quarantine(spark, f"{folder}/one").collect())
    assert held == [(0, ("positive",)), (1, ("positive",)), (2, ("positive",)), (3, ("positive",)), (7, ("unique",)), (7, ("unique",)), (19, ("small",))]
    started = []
    stages = [(lambda x: started.append("a") or x, "id", gates.Gate("a", {"ok": F.col("id") >= 0})), (lambda x: started.append("b") or x, "id", gate), (lambda x: started.append("c") or x, "id", gate)]
    with pytest.raises(gates.GateStopped):
        gates.through(df, stages)
    assert started == ["a", "b"]


def test_rows_that_pass_go_on(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "id int, v int")
    assert sorted(r.id for r in gates.passed(df, "id", gates.Gate("g", {"not_three": F.col("v") != 3}, tolerated=0.1)).collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    double = gates.through(df, [(lambda x: x.withColumn("v", F.col("v") * 2), "id", gates.Gate("g", {"even": F.col("v") % 2 == 0})), (lambda x: x.where("v > 4"), "id", gates.Gate("h", {}))])
    assert double.count() == 7 and double.columns == ["id", "v"]
    assert gates.passed(df.limit(0), "id", gates.Gate("none", {"never": F.lit(False)})).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_every_rule_is_broken_by_a_row_of_its_query(spark):
    from lodestone.catalog import checks

    queries = catalog.load()[0]
    rules = {
        "compound_constraints": constraints.compound_rules(), "likeness_constraints": constraints.likeness_rules(), "measurement_constraints": constraints.measurement_rules(),
        "endpoint_constraints": constraints.endpoint_rules(), "model_constraints": constraints.model_rules(), "descriptor_constraints": constraints.descriptor_rules(list(constraints.DESCRIPTOR_RANGES)),
    }
    for name, wanted in rules.items():
        found = {r[0] for r in queries[name](spark, FOLDER).select("rule").distinct().collect()}
        assert found == set(wanted), name
    held = {tuple(r) for r in queries["gate_quarantine"](spark, FOLDER).select("gate").distinct().collect()}
    assert held == {(g.name,) for _, _, g in checks.six_gates(spark, FOLDER)} and len(held) == 6


def test_null_is_no_breach_of_a_range(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 0, 5), (3, 10_000, 5), (4, 1, -1), (5, 1, None)], "id int, mw_g_mol int, tpsa_a2 int")
    got = sorted(tuple(r) for r in constraints.violations(df, "id", constraints.descriptor_rules(df.columns)).collect())
    assert got == [("mw_g_mol_in_range", "2"), ("mw_g_mol_in_range", "3"), ("tpsa_a2_in_range", "4")]


def plain_paths(edges, starts, hops):
    """Breadth first; of equally short paths the one that sorts first by nodes, then kinds."""
    best = {}
    for e in edges:
        if e[0] is not None and e[1] is not None:
            a, b, k = str(e[0]), str(e[1]), e[2] or ""
            best[a, b] = min(best.get((a, b), k), k)
    out = {}
    for s in map(str, starts):
        level, seen = {s: ([s], [])}, {s}
        for n in range(1, hops + 1):
            step = {}
            for node, (path, kinds) in level.items():
                for (a, b), k in best.items():
                    if a == node and b not in seen:
                        step[b] = min(step.get(b, ([*path, b], [*kinds, k])), ([*path, b], [*kinds, k]))
            seen |= set(step)
            out |= {(s, b): (n, *v) for b, v in step.items()}
            level = step
    return out


@pytest.mark.parametrize("hops", [1, 3, None])
def test_shortest_paths_with_cycles(spark, hops):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice(["a", "b", None])) for _ in range(70)] + [(1, 2, "a"), (2, 3, "a"), (3, 1, "a"), (5, 5, "a"), (None, 3, "a"), (3, None, "b")] + [(100 + i, 101 + i, "c") for i in range(9)]
    df = spark.createDataFrame(edges, "s int, t int, k string")
    starts = [1, 2, 5, 100, 777]
    got = governance.shortest_paths(df, "s", "t", "k", spark.createDataFrame([(s,) for s in [*starts, None, 1]], "id int"), hops).collect()
    assert {(r.start, r.node): (r.hops, r.path, r.kinds) for r in got} == plain_paths(edges, starts, hops or 60) and len(got) == len({(r.start, r.node) for r in got})


def test_quality_weights_sum_to_one(spark):
    assert sum(scalars.QUALITY_WEIGHTS.values()) == pytest.approx(1)
    parts = {k: F.lit(1.0) for k in scalars.QUALITY_WEIGHTS}
    assert spark.range(1).select(scalars.composite_quality(parts)).first()[0] == pytest.approx(1)
    assert spark.range(1).select(scalars.composite_quality(parts | {"curation": F.lit(None)})).first()[0] == pytest.approx(0.75)
    with pytest.raises(ValueError):
        scalars.composite_quality({"curation": F.lit(1)})
