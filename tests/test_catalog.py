"""Every query of the catalogue that has SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from lodestone import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.load()
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    r = db.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in r.fetchall())
    assert sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect()) == want


@needs_tables
def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_tables
def test_models_have_the_specified_parameters(spark):
    from lodestone.operators import ml

    r = QUERIES["bootstrap_auc"](spark, FOLDER).first()
    assert r.replicates == 1000 and r.low < r.high
    grid = {n: (m.getNumTrees(), m.getMaxDepth()) for n, m in ml.candidates("y", "weight").items() if n.startswith("rf")}
    assert grid == {f"rf_{t}_{d}": (t, d) for t in (200, 500) for d in (30, 20)} and ml.candidates("y", "weight")["gbm"].getMaxIter() == 100


def redacted(text):
    """The rules in plain Python, word by word."""
    import hashlib
    import re

    mark, digest = "[REDACTED:structure]", lambda t: f"[REDACTED:structure sha256:{hashlib.sha256(t.encode()).hexdigest()[:12]}]"

    def structure(t):
        return (
            6 <= len(t) <= 5000 and re.fullmatch(r"[A-Za-z0-9@+\-\[\]()=#$:/\\.%]+", t) and ":" not in t and not re.fullmatch("[0-9a-f]{12,}", t)
            and not re.fullmatch("[0-9A-HJKMNP-TV-Z]{26}", t) and t.count("/") <= 1 and t.count("\\") <= 1 and sum(c.isalpha() for c in t) >= 3
            and re.search(r"\[[A-Za-z][A-Za-z0-9@+\-]{0,8}\]|[bcnops]{2,}\d|\d[bcnops]{2,}|[A-Z][=#][A-Za-z(\[]|\)[=#]?[A-Z]|\([=#][A-Z]", t)
        )

    def one(m):
        t = m.group()
        body = t.rstrip(".,;:!?\"'")
        return digest(t) if structure(t) else digest(body) + t[len(body) :] if structure(body) else t

    text = re.sub(r"InChI=1S?/[^\s\"']+", mark, text)
    return re.sub(r"\S+", one, re.sub(r"\b[A-Z]{14}-[A-Z]{10}-[A-Z]\b", mark, text))


@needs_tables
def test_redaction_of_documents(spark, db, tmp_path):
    texts = [
        "one\nCC(=O)Oc1ccccc1C(=O)O\ttwo", "see CC(=O)Oc1ccccc1, then (c1ccccc1).", "f(x) is A[0]; utf8 abc123 covid19", "InChI=1S/CH4/h1H4\nnext line",
        "'ABCDEFGHIJKLMN-OPQRSTUVWX-Y' xABCDEFGHIJKLMN-OPQRSTUVWX-Y", "C=O C#N [nH]cc C[C@@H](N)C 0123456789abcdef a/b/c(=O)C t:C=OCCC", "  \n ", "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.safe for r in QUERIES["redact_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else redacted(t) for i, t in enumerate(texts)} and got[0].startswith("one\n[REDACTED:structure sha256:")
    want = {k: t if t is None else redacted(t) for k, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.safe for r in QUERIES["redact_documents"](spark, FOLDER).collect()} == want


@needs_tables
def test_unit_conversion_of_every_line(spark, db):
    assert QUERIES["unit_conversion_lines"](spark, FOLDER).count() == db.execute("SELECT count(*) FROM lineitem").fetchone()[0]
