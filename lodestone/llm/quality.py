"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample; rules then run by rejection per
cost, and the first that rejects a text ends its cascade. The verdict is that of all rules together,
so it doesn't depend on the order or on the timings.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: At most so many rows, drawn at random, on which cost and selectivity are measured.
SAMPLE_ROWS = 1_000
_SLICE = 256


class Text:
    """What the rules ask of a text, computed when first asked."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes split at ASCII white space alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        ids: dict[bytes, int] = {}
        return np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside five-word windows that occur twice or more."""
        n = self.n_words - 4
        if n < 2:
            return 0
        w = self.word_ids
        kinds = int(w.max()) + 1
        if kinds == len(w):
            return 0
        if kinds < 6_000:  # five ids fit in 63 bits
            key = (((w[:n] * kinds + w[1 : n + 1]) * kinds + w[2 : n + 2]) * kinds + w[3 : n + 3]) * kinds + w[4:]
        else:
            pair = np.unique(w[:-1] * kinds + w[1:], return_inverse=True)[1]
            four = np.unique(pair[:-2] * len(w) + pair[2:], return_inverse=True)[1]
            key = four[:n] * kinds + w[4:]
        ordered = np.sort(key)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            return 0
        starts = np.flatnonzero(np.isin(key, again))
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + 5, -1)
        return int((np.cumsum(cover) > 0).sum())

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        w = self.word_ids
        return int((w[1:] == w[:-1]).sum())

    @cached_property
    def capitals(self) -> tuple[int, int]:
        return sum(map(str.isupper, self.text)), sum(map(str.isalpha, self.text))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def _too_short(t: Text) -> bool:
    return t.n_words < 10


def _repeated_words(t: Text) -> bool:
    return 100 * t.n_repeat_words > 20 * t.n_words


def _symbols(t: Text) -> bool:
    return 10 * t.n_symbols > t.n_words


def _exclaiming(t: Text) -> bool:
    return 2 * (t.text.count("!") + t.text.count("?")) > t.n_words


def _shouting(t: Text) -> bool:
    upper, letters = t.capitals
    return 2 * upper > letters


def _duplicate_lines(t: Text) -> bool:
    return 2 * t.n_dup_lines > len(t.lines)


def _stutter(t: Text) -> bool:
    return 5 * t.n_stutters > t.n_words


def _word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 20 * t.n_words


#: The first two are the base; the others reject symbol soup, shouting, repetition and non-words.
RULES = (
    Rule("too_short", _too_short),
    Rule("repeated_words", _repeated_words),
    Rule("symbols", _symbols),
    Rule("exclaiming", _exclaiming),
    Rule("shouting", _shouting),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("stutter", _stutter),
    Rule("word_length", _word_length),
)


class Measured(NamedTuple):
    name: str
    seconds: float
    rejected: int


def measure(texts: list[str | None], rules=RULES) -> list[Measured]:
    """Each rule alone on fresh texts: its seconds and how many it rejects."""
    out = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(Text(t)) for t in texts)
        out.append(Measured(rule.name, time.perf_counter() - began, rejected))
    return out


def plan_cascade(df: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on the sample, most first; ties in the given order."""
    share = min(1.0, 1.5 * sample_rows / max(df.count(), 1))
    texts = df.select(F.col(text_col).alias("text"))
    sample = (texts.sample(share, seed=1) if share < 1 else texts).limit(sample_rows).coalesce(1)

    def run(batches):
        for b in batches:  # a few texts at a time, however long they are
            for i in range(0, b.num_rows, 16):
                yield pa.RecordBatch.from_pylist([r._asdict() for r in measure(b.column(0).slice(i, 16).to_pylist(), rules)])

    measured = [Measured(*r) for r in sample.mapInArrow(run, "name string, seconds double, rejected long").collect()]
    totals: dict[str, list[float]] = {}
    for m in measured:
        t = totals.setdefault(m.name, [0.0, 0])
        t[0], t[1] = t[0] + m.seconds, t[1] + m.rejected
    rate = {name: rejected / max(seconds, 1e-9) for name, (seconds, rejected) in totals.items()}
    return sorted((r.name for r in rules), key=lambda n: -rate.get(n, 0.0))


def kept(text: Text, ordered: list[Rule]) -> bool:
    return not any(rule.rejects(text) for rule in ordered)


REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row of df the base measures and the cascade's verdict.

    A null or empty text has no words and fails the base. Repeated rows are judged each; other
    columns aren't read. An empty table gives no rows.
    """
    ordered = _ordered(df, text_col, rules)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                part = batch.slice(i, _SLICE)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t = Text(text)
                    failed = _too_short(t) or _repeated_words(t)
                    rows.append(
                        (doc, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and kept(t, ordered))
                    )
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in REPORT.split(", ")]
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, REPORT)


def _ordered(df: DataFrame, text_col: str, rules) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[n] for n in plan_cascade(df, text_col, rules)]


def quality_filter(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of df that no rule rejects, with all its columns; rejected texts cost only the rules
    up to the one that rejects them. Null and empty texts are rejected; identifiers aren't read, so null
    and repeated ones are judged each; df's names clash with none. An empty table gives no rows."""
    ordered = _ordered(df, text_col, rules)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([kept(Text(t), ordered) for t in texts], dtype=bool)

    return df.where(passes(F.col(text_col)))
