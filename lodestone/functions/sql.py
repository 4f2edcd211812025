"""Rules as SQL functions of a session, which the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestone.operators.reliability import BORDER_SIMILARITY, OUT_SIMILARITY, SIGNIFICANCE

FUNCTIONS = {
    "domain_verdict": f"""(similarity DOUBLE, distance DOUBLE, distance_limit DOUBLE, seen BOOLEAN) RETURNS STRING RETURN
      CASE WHEN similarity IS NULL OR distance IS NULL OR distance_limit IS NULL THEN 'undeterminable' WHEN similarity < {OUT_SIMILARITY}D THEN 'out_of_domain'
      ELSE element_at(array('in_domain', 'borderline', 'out_of_domain', 'out_of_domain'), 1 + int(similarity < {BORDER_SIMILARITY}D) + int(distance > distance_limit) + int(NOT coalesce(seen, false))) END""",
    "lipinski_violations": "(mw DOUBLE, logp DOUBLE, hbd INT, hba INT) RETURNS INT RETURN int(mw > 500) + int(logp > 5) + int(hbd > 5) + int(hba > 10)",
    "bioavailability_score": """(charge INT, tpsa DOUBLE, lipinski_pass BOOLEAN) RETURNS DOUBLE RETURN
      CASE WHEN charge < 0 THEN CASE WHEN tpsa <= 75 THEN 0.85D WHEN tpsa < 150 THEN 0.56D ELSE 0.11D END WHEN lipinski_pass THEN 0.55D ELSE 0.17D END""",
    "prediction_set": f"(p_one DOUBLE, p_zero DOUBLE) RETURNS TABLE (label INT) RETURN SELECT explode(array_compact(array(if(p_one > {SIGNIFICANCE!r}D, 1, NULL), if(p_zero > {SIGNIFICANCE!r}D, 0, NULL))))",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
    return list(FUNCTIONS)
