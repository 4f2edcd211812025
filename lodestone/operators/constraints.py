"""Declarative constraints: each rule gives its violating rows, and a gate passes if there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for each row that breaks a rule; a null condition isn't a breach, as in CHECK."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """Non-null references to a parent that isn't there."""
    missing = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.col(child_key).cast("string").alias("key"))


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"))


def several_groups(df: DataFrame, key: str, group: str, rule: str) -> DataFrame:
    """Keys that must lie in one group and don't."""
    return df.groupBy(key).agg(F.count_distinct(group).alias("_n")).where("_n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def missing_members(df: DataFrame, key: str, member: str, required: list[str], rule: str) -> DataFrame:
    """Keys that lack one of the required members."""
    have = F.size(F.array_intersect(F.collect_set(member), F.array(*map(F.lit, required))))
    return df.groupBy(key).agg(have.alias("_n")).where(F.col("_n") < len(required)).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gate(found: DataFrame) -> DataFrame:
    """Rows by rule, and whether the gate passes."""
    return found.agg(F.count(F.lit(1)).alias("violations"), (F.count(F.lit(1)) == 0).alias("passed"))


def tier_rules(tier: Column, commercial_ok: Column, sharealike: Column) -> dict[str, Column]:
    return {"black_is_not_commercial": (tier == "black") == ~commercial_ok, "red_is_sharealike": (tier == "red") == sharealike}


#: The closed or open ranges of descriptors and of likeness scores; (low, low is in, high, high is in).
DESCRIPTOR_RANGES = {
    "mw_g_mol": (0, False, 10_000, False), "mw_parent_g_mol": (0, False, None, False), "exact_mass_g_mol": (0, False, None, False), "molar_refractivity": (0, True, None, False),
    "tpsa_a2": (0, True, 1_000, False), "rotatable_bonds": (0, True, 200, True), "aromatic_rings": (0, True, None, False), "ring_count": (0, True, None, False),
    "heavy_atom_count": (0, False, None, False), "formal_charge": (-20, True, 20, True), "hbd_lipinski": (0, True, None, False), "hba_lipinski": (0, True, None, False),
    "hbd_strict": (0, True, None, False), "hba_strict": (0, True, None, False), "heteroatom_count": (0, True, None, False), "fraction_csp3": (0, True, 1, True),
    "num_stereocentres": (0, True, None, False), "largest_ring_size": (0, True, None, False),
}
LIKENESS_RANGES = {
    "lipinski_violations": (0, True, 4, True), "qed_score": (0, True, 1, True), "sa_score": (1, True, 10, True), "pains_alerts": (0, True, None, False),
    "brenk_alerts": (0, True, None, False), "cns_mpo_score": (0, True, 6, True),
}
MEASUREMENT_RANGES = {
    "ph_reference": (0, True, 14, True), "temperature_c": (-80, True, 200, True), "n_replicates": (0, False, None, False), "std_error": (0, True, None, False), "confidence_score": (0, True, 1, True),
}
#: The sets that columns are of.
BIOAVAILABILITY = (0.11, 0.17, 0.55, 0.56, 0.85)
UNIT_METHODS = ("documented", "range_assertion", "cross_source", "unverified")
TIERS = ("green", "amber", "red", "black")
WITHOUT_VALUE = ("not_measured", "inconclusive", "withdrawn_by_source")


def within(ranges: dict[str, tuple]) -> dict[str, Column]:
    """A rule `<column>_in_range` for each column."""

    def one(c: Column, low, low_in: bool, high, high_in: bool) -> Column:
        above = c >= low if low_in else c > low
        return above if high is None else above & (c <= high if high_in else c < high)

    return {f"{name}_in_range": one(F.col(name), *bounds) for name, bounds in ranges.items()}


def present(*names: str) -> dict[str, Column]:
    """A rule `<column>_present` for each column."""
    return {f"{name}_present": F.col(name).isNotNull() for name in names}


def compound_rules() -> dict[str, Column]:
    """Of rows with inchikey_full, inchikey_skeleton, is_deleted, deleted_reason, is_mixture, parent_inchikey."""
    return {
        "skeleton_is_prefix": F.left("inchikey_full", F.lit(14)) == F.col("inchikey_skeleton"), "deleted_has_reason": ~F.col("is_deleted") | F.col("deleted_reason").isNotNull(),
        "mixture_has_no_parent": ~F.col("is_mixture") | F.col("parent_inchikey").isNull(),
    }


def descriptor_rules(columns: list[str]) -> dict[str, Column]:
    """Ranges of the descriptors that the table has, and masses that agree to half a dalton."""
    rules = within({k: v for k, v in DESCRIPTOR_RANGES.items() if k in columns})
    return rules | ({"masses_agree": F.abs(F.col("exact_mass_g_mol") - F.col("mw_g_mol")) < 0.5} if {"exact_mass_g_mol", "mw_g_mol"} <= set(columns) else {})


def likeness_rules() -> dict[str, Column]:
    return within(LIKENESS_RANGES) | {
        "bioavailability_in_set": F.col("bioavailability_score").isin(*BIOAVAILABILITY), "pass_follows_violations": F.col("lipinski_pass") == (F.col("lipinski_violations") <= 1),
    }


def measurement_rules() -> dict[str, Column]:
    """A predicted value is no measurement; what a status needs is there; the tier is one with a partition."""
    status = F.col("measurement_status")
    backed = F.when(status == "measured", F.col("canonical_value").isNotNull()).when(status.isin("below_loq", "above_loq"), F.col("loq_value").isNotNull()).otherwise(status.isin(*WITHOUT_VALUE))
    return within(MEASUREMENT_RANGES) | {
        "never_predicted": F.col("evidence_type") != "predicted", "status_is_backed": backed, "logd_has_ph": (F.col("endpoint_id") != "logd_74") | F.col("ph_reference").isNotNull(),
        "deleted_has_reason": ~F.col("is_deleted") | F.col("deleted_reason").isNotNull(), "tier_has_partition": F.coalesce(F.col("license_tier").isin(*TIERS), F.lit(False)),
        "unit_method_known": F.col("unit_verified_method").isin(*UNIT_METHODS),
    }


def endpoint_rules() -> dict[str, Column]:
    categorical = F.col("is_categorical")
    return {
        "continuous_has_bounds": categorical | (F.col("expected_min").isNotNull() & F.col("expected_max").isNotNull()),
        "direction_is_decided": categorical | F.col("higher_is_worse").isNotNull() | (F.col("endpoint_class") == "physicochemical"),
        "unit_method_known": F.col("unit_verified_method").isin(*UNIT_METHODS),
    }


def model_rules() -> dict[str, Column]:
    """Commercial use follows from the training tiers; a regulatory model is a validated one; its domain is defined."""
    return {
        "commercial_follows_tiers": F.col("is_commercial_ok") == ~F.array_contains("training_license_tiers", "black"),
        "regulatory_is_validated": ~F.col("is_regulatory_ready") | F.col("is_validated"),
    } | present("ad_definition", "artifact_sha256")


def prediction_rules(low: Column, value: Column, high: Column) -> dict[str, Column]:
    return {"interval_whole_or_absent": low.isNull() == high.isNull(), "interval_holds_value": (low <= value) & (value <= high)}


def run_rules(started: Column, completed: Column, terminal: Column, parsed: Column, imported: Column) -> dict[str, Column]:
    return {"completed_after_start": completed >= started, "terminal_is_completed": ~terminal | completed.isNotNull(), "imported_within_parsed": imported <= parsed}


def feature_set_mismatches(predictions: DataFrame, versions: DataFrame, version: str, feature_set: str, key: str) -> DataFrame:
    """Predictions whose feature set isn't that of their model version, or whose version is unknown."""
    v = versions.select(F.col(version), F.col(feature_set).alias("_model_set"))
    joined = predictions.join(v, version, "left").where(~F.col(feature_set).eqNullSafe(F.col("_model_set")))
    rule = F.when(F.col("_model_set").isNull(), "unknown_model_version").otherwise("feature_set_mismatch")
    return joined.select(rule.alias("rule"), F.col(key).cast("string").alias("key"))


#: The methodologies of the two predictions that an assessment rests on.
RULE_BASED, STATISTICAL = "expert_rule_based", "statistical_based"


def methodology_pairs(assessments: DataFrame, methods: DataFrame, rule_based: str, statistical: str, key: str, review: str, needs_review: str, conclusion: str, conclusion_class: str) -> DataFrame:
    """(rule, key) of assessments that break a rule: two different predictions, the one of a rule-based model
    and the other of a statistical one, a review where it is needed, and no conclusion without a class.

    methods: prediction, methodology; a prediction that isn't there has none.
    """
    m1 = methods.select(F.col("prediction").alias(rule_based), F.col("methodology").alias("_m1"))
    m2 = methods.select(F.col("prediction").alias(statistical), F.col("methodology").alias("_m2"))
    joined = assessments.join(m1, rule_based, "left").join(m2, statistical, "left")
    return violations(joined, key, {
        "distinct_predictions": F.col(rule_based) != F.col(statistical),
        "rule_based_methodology": F.col("_m1").eqNullSafe(RULE_BASED),
        "statistical_methodology": F.col("_m2").eqNullSafe(STATISTICAL),
        "review_when_required": ~F.col(needs_review) | F.col(review).isNotNull(),
        "conclusion_requires_class": F.col(conclusion).isNull() | F.col(conclusion_class).isNotNull(),
    })


def record_hash(*columns: Column) -> Column:
    """Digest of a record for its signature."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def visible_to(df: DataFrame, key_hash: str, caller: str) -> DataFrame:
    """Rows that the caller owns; another's look as if they didn't exist."""
    return df.where(F.col(key_hash) == F.sha2(F.lit(caller), 256))


def same_definition(in_use: DataFrame, approved: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Whether every approved definition is in use unchanged."""
    both = approved.join(in_use.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.bool_and(same).alias("unchanged"))
