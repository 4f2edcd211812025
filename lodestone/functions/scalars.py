"""Scalar column functions: identifiers, digests, redaction, acceptance rules, unit helpers."""

from __future__ import annotations

import os
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Fixed value: Crockford's base-32 alphabet, of which the identifiers are made.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

#: The shapes of identifiers.
DOMAINS = {
    "ulid": r"^[0-9A-HJKMNP-TV-Z]{26}$",
    "inchikey27": r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$",
    "inchikey14": r"^[A-Z]{14}$",
    "sha256_hex": r"^[0-9a-f]{64}$",
    "git_sha": r"^[0-9a-f]{40}$",
    "semver": r"^[0-9]+\.[0-9]+\.[0-9]+$",
}


def in_domain(value: Column, domain: str) -> Column:
    return value.rlike(DOMAINS[domain])


def _ulids(seed: pd.Series) -> pd.Series:
    now = int(time.time() * 1000)

    def one() -> str:
        n = now << 80 | int.from_bytes(os.urandom(10), "big")
        return "".join(ALPHABET[n >> 5 * i & 31] for i in range(25, -1, -1))

    return pd.Series([one() for _ in range(len(seed))], dtype=object)


def new_ulid(seed: Column) -> Column:
    """Time-ordered identifiers, one for each row; not repeatable by intent."""
    return F.pandas_udf(_ulids, "string").asNondeterministic()(seed)


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds since the epoch in the first ten characters."""
    out = F.lit(0).cast("long")
    for i in range(1, 11):
        out = out * 32 + F.instr(F.lit(ALPHABET), F.substr(ulid, F.lit(i), F.lit(1))) - 1
    return out


def public_id(prefix: Column, ulid: Column) -> Column:
    return F.concat_ws("_", prefix, ulid)


def parse_public_id(value: Column) -> Column:
    """struct<prefix, ulid>; null where the form isn't that of a public identifier."""
    form = r"^([a-z]+)_([0-9A-HJKMNP-TV-Z]{26})$"
    parts = F.struct(F.regexp_extract(value, form, 1).alias("prefix"), F.regexp_extract(value, form, 2).alias("ulid"))
    return F.when(value.rlike(form), parts)


def _demanded(ok: Column, value: Column, strict: bool, message: str, *shown: Column) -> Column:
    """value where ok holds; else null, or with strict an error that shows what was given."""
    if not strict:
        return F.when(ok, value)
    given = F.concat_ws(", ", *[F.coalesce(c.cast("string"), F.lit("null")) for c in shown])
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), given)))


def snapshot_id(version: Column, day: Column, sha: Column, strict: bool = False) -> Column:
    """version__YYYY-MM-DD__first 12 of the digest; where version holds "__", the digest is short or a part is null:
    null, or with strict an error."""
    ok = ~F.contains(version, F.lit("__")) & (F.length(sha) >= 12) & day.isNotNull()
    value = F.concat_ws("__", version, F.date_format(day, "yyyy-MM-dd"), F.substr(sha, F.lit(1), F.lit(12)))
    return _demanded(ok, value, strict, "not the parts of a snapshot's identifier", version, day, sha)


def parse_snapshot_id(value: Column) -> Column:
    form = r"^(.+)__([0-9]{4}-[0-9]{2}-[0-9]{2})__([0-9a-f]{12})$"
    names = ("version", "day", "sha12")
    return F.when(value.rlike(form), F.struct(*[F.regexp_extract(value, form, i + 1).alias(n) for i, n in enumerate(names)]))


def landing_key(tier: Column, source: Column, snapshot: Column, file: Column, strict: bool = False) -> Column:
    """tier/source/snapshot/file; where a part holds a slash, is empty or null: null, or with strict an error."""
    parts = [tier, source, snapshot, file]
    ok = F.lit(True)
    for p in parts:
        ok = ok & (p != "") & ~F.contains(p, F.lit("/"))
    return _demanded(ok, F.concat_ws("/", *parts), strict, "not the parts of a landing key", *parts)


def feature_set_id(version: Column, toolchain: Column, names: Column) -> Column:
    """SHA-256 of the joined fields with the names in order, so their order of arrival doesn't count."""
    return F.sha2(F.concat_ws("||", version, toolchain, F.concat_ws("||", F.array_sort(names))), 256)


def short_digest(value: Column, n: int = 12) -> Column:
    return F.substr(F.sha2(value, 256), F.lit(1), F.lit(n))


def digest_matches(content: Column, expected: Column) -> Column:
    return F.lower(F.sha2(content, 256)) == F.lower(expected)


def skeleton(key: Column) -> Column:
    """The first block of a structure key."""
    return F.left(key, F.lit(14))


def without_charge(formula: Column) -> Column:
    return F.regexp_replace(formula, r"[+-][0-9]*$", "")


def toolchain_id(tool: Column, python: Column, pipeline: Column) -> Column:
    return F.concat(F.lit("chem-"), tool, F.lit("__python-"), python, F.lit("__stdpipe-"), pipeline)


#: Keys whose values are structures, the marks, and the patterns of structures in text: the
#: alphabet of a line notation; evidence of bracket atoms, rings closed beside aromatic atoms, explicit
#: bonds and branches; digests, which only look like one.
SENSITIVE_KEYS = (
    "smiles", "canonical_smiles", "isomeric_smiles", "standardized_smiles", "parent_smiles", "source_smiles", "structure", "structure_value", "molblock", "molfile",
    "sdf", "mol", "inchi", "inchikey", "inchikey_full", "parent_inchikey", "scaffold", "bemis_murcko_scaffold", "query_structure",
)
MARK, DIGEST_MARK = "[REDACTED:structure]", "[REDACTED:structure sha256:"
INCHI, INCHIKEY = r"InChI=1S?/[^\s\"']+", r"\b[A-Z]{14}-[A-Z]{10}-[A-Z]\b"
NOTATION = r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%]+$"
EVIDENCE = r"\[[A-Za-z][A-Za-z0-9@+\-]{0,8}\]|[bcnops]{2,}[0-9]|[0-9][bcnops]{2,}|[A-Z][=#][A-Za-z(\[]|\)[=#]?[A-Z]|\([=#][A-Z]"
HEXADECIMAL = "^[0-9a-f]{12,}$"


def digest_mark(structure: Column) -> Column:
    """The mark of a structure, with a digest by which marks of one structure can be linked."""
    return F.concat(F.lit(DIGEST_MARK), short_digest(structure), F.lit("]"))


def redact(text: Column) -> Column:
    """Structure keys and strings in a text replaced by a mark, and tokens that look like a structure by
    a mark with their digest; a token may end in punctuation. Null stays null."""
    text = F.regexp_replace(F.regexp_replace(text, INCHI, MARK), INCHIKEY, MARK)

    def replaced(w: Column) -> Column:
        body = F.regexp_replace(w, "[.,;:!?\"']+$", "")
        found = F.when(looks_like_structure(w), digest_mark(w)).when(looks_like_structure(body), F.concat(digest_mark(body), F.substr(w, F.length(body) + 1)))
        return F.when(~w.rlike(EVIDENCE), w).otherwise(F.coalesce(found, w))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\S+|\s+"), F.lit(0)), replaced), "")


def redact_nested(value: Column, kind: DataType, key: str | None = None) -> Column:
    """A value of any type, redacted by its names and its texts: under a sensitive key a text becomes a mark
    with its digest and anything else, null too, the mark alone; otherwise structs, arrays and maps of
    texts are gone through."""
    if key is not None and key.lower() in SENSITIVE_KEYS:
        return F.coalesce(digest_mark(value), F.lit(MARK)) if isinstance(kind, StringType) else F.lit(MARK)
    if isinstance(kind, StringType):
        return redact(value)
    if isinstance(kind, StructType):
        fields = [redact_nested(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType) and isinstance(kind.valueType, StringType):
        sensitive = lambda k: F.lower(k).isin(*SENSITIVE_KEYS)
        return F.transform_values(value, lambda k, v: F.when(sensitive(k), redact_nested(v, kind.valueType, SENSITIVE_KEYS[0])).otherwise(redact_nested(v, kind.valueType)))
    return value


def redacted_events(df: DataFrame) -> DataFrame:
    """df with every column redacted by its name and type."""
    return df.select(*[redact_nested(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def looks_like_structure(word: Column) -> Column:
    """A line notation of a structure: of its alphabet, with evidence of bonds, rings or branches, and
    none of the things that only look like one (digests, identifiers, times, hosts, paths)."""
    n = F.length(word)
    count = lambda kept: F.length(F.regexp_replace(word, kept, ""))
    return (
        n.between(6, 5000) & word.rlike(NOTATION) & ~F.contains(word, F.lit(":")) & ~word.rlike(HEXADECIMAL) & ~in_domain(word, "ulid")
        & (count("[^/]") <= 1) & (count(r"[^\\]") <= 1) & (count("[^A-Za-z]") >= 3) & word.rlike(EVIDENCE)
    )


#: The codes of the acceptance rules, in the order in which they are asked.
REJECTIONS = ("EMPTY_INPUT", "INPUT_TOO_LONG", "WILDCARD_ATOM", "MIXTURE", "NO_DESCRIPTORS", "TOO_HEAVY")


def rejection_reason(structure: Column, is_mixture: Column, has_descriptors: Column, weight: Column, longest: int = 5000, heaviest: float = 2000.0) -> Column:
    """The first acceptance rule that fails, else null."""
    blank = structure.isNull() | (F.trim(structure) == "")
    fails = (blank, F.length(structure) > longest, F.contains(structure, F.lit("*")), is_mixture, ~has_descriptors, weight > heaviest)
    return F.coalesce(*[F.when(failed, code) for failed, code in zip(fails, REJECTIONS)])


#: Keywords by assay paradigm, tried in order.
PARADIGMS = (
    ("functional_electrophysiology", ("patch clamp", "patch-clamp", "voltage clamp", "ikr current", "delayed rectifying")),
    ("functional_flux_fluorescence", ("flipr", "flux assay", "thallium", "fluorescence", "rb+ flux", "86rb")),
    ("binding_displacement", ("binding", "displacement", "radioligand", "[3h]", "mk499", "mk-499", "astemizole binding")),
    ("ambiguous_generic_inhibition", ("inhibition", "activity", "block")),
)


def first_category(text: Column, rules=PARADIGMS, unknown: str = "other_unclassified") -> Column:
    """The first category of which a keyword occurs, case aside; null text is of none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(unknown)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def canonical_value(source: Column, factor: Column) -> Column:
    """Unit conversion in exact decimals."""
    return (source.cast("decimal(18,6)") * factor.cast("decimal(18,9)")).cast("decimal(18,6)")


def half_life_fold(clearance: Column, volume: Column, half_life: Column) -> Column:
    """How far a stated half-life is from ln 2 * volume / clearance, as a fold of at least 1."""
    implied = F.lit(0.6931471805599453) * volume / clearance
    return F.greatest(implied / half_life, half_life / implied)


def quality_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of measures between 0 and 1; a null measure counts as 0."""
    total = sum(w for _, w in parts.values())
    return sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0)) / total


def filled(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


#: The components of a measurement's quality and their weights, version 1.
QUALITY_WEIGHTS = {"curation": 0.25, "assay_confidence": 0.20, "replication": 0.15, "concordance": 0.15, "guideline": 0.15, "provenance": 0.10}


def composite_quality(parts: dict[str, Column]) -> Column:
    """The weighted sum of six components between 0 and 1; one that is null counts as 0."""
    if set(parts) != set(QUALITY_WEIGHTS):
        raise ValueError(f"the components are {', '.join(QUALITY_WEIGHTS)}")
    return sum((F.coalesce(parts[k].cast("double"), F.lit(0.0)) * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0))


_ATOM = r"([A-Z][a-z]?)([0-9]*)"


def elements(formula: Column) -> Column:
    """map<element, atoms> of a molecular formula, a charge aside; an element that comes twice is summed. Empty for what
    holds no element, null for null."""
    plain = without_charge(formula)
    names, numbers = F.regexp_extract_all(plain, F.lit(_ATOM), F.lit(1)), F.regexp_extract_all(plain, F.lit(_ATOM), F.lit(2))
    atoms = F.zip_with(names, numbers, lambda e, n: F.struct(e.alias("e"), F.coalesce(F.when(n == "", 1).otherwise(n.try_cast("int")), F.lit(0)).alias("n")))
    count = lambda e: F.aggregate(F.filter(atoms, lambda a: a["e"] == e), F.lit(0), lambda s, a: s + a["n"])
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda e: F.struct(e, count(e))))


def unseen_elements(formula: Column, known: Column) -> Column:
    """Elements of a formula that aren't among the known ones, sorted."""
    return F.array_sort(F.array_except(F.map_keys(elements(formula)), known))
