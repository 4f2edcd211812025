"""The structure stage: a chemistry toolchain plugged into mapInPandas.

A toolchain is a callable on one structure string that returns a dict of the fields of RESULT or
raises StructureError. None is bundled; without one the stage says so rather than make results up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = (
    "key27 string, canonical string, standardized string, scaffold string, formula string, n_fragments int, n_salts int, "
    "is_mixture boolean, n_centres int, n_defined int, descriptors array<double>, bits array<int>, flags array<string>"
)
_FIELDS = [c.split()[0] for c in RESULT.split(", ")]


class StructureError(ValueError):
    """A structure that can't be processed; its message never holds the structure."""


class ToolchainAbsent(RuntimeError):
    """No chemistry toolchain was given."""


def process_structures(df: DataFrame, id_col: str, structure_col: str, toolchain: Callable[[str], dict] | None) -> DataFrame:
    """df's identifiers with RESULT and error; mixtures have null descriptors and bits.

    Null and blank structures, and those that the toolchain refuses, are error rows; the batch goes on.
    """
    if toolchain is None:
        raise ToolchainAbsent("structure processing needs a chemistry toolchain")

    def one(structure) -> dict:
        if structure is None or not str(structure).strip():
            return {"error": "blank structure"}
        try:
            out = dict(toolchain(structure))
        except StructureError as e:
            return {"error": str(e)}
        if out.get("is_mixture"):
            out["descriptors"] = out["bits"] = None
        return out | {"error": None}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [one(s) for s in f["_structure"]]
            out = pd.DataFrame([[r.get(k) for k in [*_FIELDS, "error"]] for r in rows], columns=[*_FIELDS, "error"], dtype=object)
            out.insert(0, "_id", f["_id"].to_numpy())
            yield out

    kind = dict(df.dtypes)[id_col]
    picked = df.selectExpr(f"`{id_col}` as _id", f"`{structure_col}` as _structure")
    return picked.mapInPandas(run, f"_id {kind}, {RESULT}, error string").withColumnRenamed("_id", id_col)
