"""Drug-likeness rules and structure decision tables, as expressions over descriptor columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lipinski_violations(mw: Column, logp: Column, hbd: Column, hba: Column) -> Column:
    return (mw > 500).cast("int") + (logp > 5).cast("int") + (hbd > 5).cast("int") + (hba > 10).cast("int")


def rules(d: dict[str, Column]) -> dict[str, Column]:
    """d: mw, logp, tpsa, mr, hbd, hba, rotb, heavy_atoms, ring_count, heteroatoms, carbons, logd."""
    mw, logp, tpsa, mr, hbd, hba, rotb = (d[k] for k in ("mw", "logp", "tpsa", "mr", "hbd", "hba", "rotb"))
    violations = lipinski_violations(mw, logp, hbd, hba)
    return {
        "lipinski_violations": violations,
        "lipinski_pass": violations <= 1,
        "veber_pass": (rotb <= 10) & (tpsa <= 140),
        "ghose_pass": mw.between(160, 480) & logp.between(-0.4, 5.6) & mr.between(40, 130) & d["heavy_atoms"].between(20, 70),
        "egan_pass": (tpsa <= 131.6) & (logp <= 5.88),
        "muegge_pass": mw.between(200, 600) & logp.between(-2, 5) & (tpsa <= 150) & (d["ring_count"] <= 7) & (d["carbons"] > 4)
        & (d["heteroatoms"] > 1) & (rotb <= 15) & (hbd <= 5) & (hba <= 10),
        "ro3_pass": (mw < 300) & (logp <= 3) & (hbd <= 3) & (hba <= 3) & (rotb <= 3),
        # Known only where logD is, though it looks at logP.
        "pfizer_3_75_flag": F.when(d["logd"].isNotNull(), (logp > 3) & (tpsa < 75)),
        "gsk_4_400_flag": (logp > 4) & (mw > 400),
    }


def bioavailability(charge: Column, tpsa: Column, lipinski_pass: Column) -> Column:
    anion = F.when(tpsa <= 75, 0.85).when(tpsa < 150, 0.56).otherwise(0.11)
    return F.when(charge < 0, anion).otherwise(F.when(lipinski_pass, 0.55).otherwise(0.17))


def stereo_class(n_centres: Column, n_defined: Column) -> Column:
    return F.when(n_centres == 0, "none").when(n_defined == n_centres, "complete").when(n_defined == 0, "undefined").otherwise("partial")


def fragment_class(n_fragments: Column, n_salts: Column) -> Column:
    """Which fragment is the parent: the only one, the only one that isn't a salt, or none."""
    others = n_fragments - n_salts
    return (
        F.when(n_fragments == 1, "single").when(others == 1, "parent_with_salt").when(others == 0, "salt_only").otherwise("mixture")
    )
