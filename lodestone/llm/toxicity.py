"""Toxicity by weak supervision.

Labelled rows give lexicons: words and word beginnings that toxic texts hold far more often. They are
dealt to many voters; a generative label model, fitted by expectation maximisation to the counts of
vote patterns over all documents, estimates every voter's rates and the correlations between voters
(correlated voters share their weight). A linear classifier learns the model's posteriors on a
bounded sample and scores all texts.

One pass over the texts writes every document's votes and features; counts, training rows and scores come
from that narrow table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_sample, materialize

#: At most so many labelled texts give the lexicons, and so many documents train the classifier: those
#: with the smallest hash of identifier and text.
LABELLED_ROWS = 8_000
TRAIN_ROWS = 12_000
#: The lexicons hold at most TERMS terms, those in most toxic texts: in LEAST_TEXTS of them at least, and
#: at LEAST_ODDS times the rate of clean ones.
LEAST_TEXTS, LEAST_ODDS, TERMS = 4, 20.0, 1_500
WORD_VOTERS, PREFIX_VOTERS = 5, 5
PREFIXES = (4, 5, 6)
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MEMORY = 400_000


def distinct_words(text: str | None) -> set[str]:
    return {w for w in (_EDGE.sub("", x) for x in set((text or "").lower().split())) if w}


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word] + [word[:n] + "-" for n in PREFIXES if len(word) > n]


class Voters(NamedTuple):
    """Bit i of a mask is voter i's vote: word lexicons, prefix lexicons, and hit-count patterns."""

    words: dict[str, int]
    prefixes: dict[str, int]

    @property
    def count(self) -> int:
        return WORD_VOTERS + PREFIX_VOTERS + 4

    def mask(self, words: Collection[str]) -> int:
        out, hits, starts = 0, 0, 0
        for w in words:
            v = self.words.get(w)
            if v is not None:
                out, hits = out | 1 << v, hits + 1
            found = {self.prefixes[p] for p in (w[:n] + "-" for n in PREFIXES if len(w) > n) if p in self.prefixes}
            starts += bool(found)
            for v in found:
                out |= 1 << (WORD_VOTERS + v)
        base = WORD_VOTERS + PREFIX_VOTERS
        for i, on in enumerate((hits >= 2, starts >= 2, hits + starts >= 3, 50 * (hits + starts) >= len(words) > 0)):
            out |= on << (base + i)
        return out


def voters_from(odds: list[tuple[str, float]]) -> Voters:
    """Terms are dealt in descending odds, so that every voter has some of the telling ones."""
    words = [t for t, _ in odds if not t.endswith("-")]
    starts = [t for t, _ in odds if t.endswith("-")]
    return Voters({t: i % WORD_VOTERS for i, t in enumerate(words)}, {t: i % PREFIX_VOTERS for i, t in enumerate(starts)})


class LabelModel(NamedTuple):
    prior: float
    rates: np.ndarray  # [voter, class]
    share: np.ndarray  # a voter's weight after correlations

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[:, 1] / self.rates[:, 0])
        off = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0]))
        logit = math.log(self.prior / (1 - self.prior)) + (votes * (on * self.share) + (1 - votes) * (off * self.share)).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def bits(masks: np.ndarray, voters: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(voters)) & 1).astype(float)


def fit_label_model(masks: np.ndarray, counts: np.ndarray, voters: int, start: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation maximisation over vote patterns, from rates seen on labelled rows."""
    votes = bits(masks, voters)
    model = LabelModel(prior, start, np.ones(voters))
    for _ in range(rounds):
        toxic = model.posterior(votes)
        rates, residual = np.empty((voters, 2)), np.zeros((voters, voters))
        for y, weight in ((0, counts * (1 - toxic)), (1, counts * toxic)):
            total = weight.sum() + 2.0
            rates[:, y] = np.clip(((weight[:, None] * votes).sum(0) + 1.0) / total, 1e-4, 1 - 1e-4)
            off = votes - rates[:, y]
            cov = (weight[:, None] * off).T @ off / total
            sd = np.sqrt(np.diag(cov)) + 1e-9
            residual += cov / np.outer(sd, sd) * (weight.sum() / counts.sum())
        np.fill_diagonal(residual, 0)
        share = 1 / (1 + np.clip(residual, 0, 1).sum(1))
        prior = float(np.clip((counts * toxic).sum() / counts.sum(), 1e-4, 1 - 1e-4))
        model = LabelModel(prior, rates, share)
    return model


def fit_linear(rows: list[list[int]], target: np.ndarray, n: int, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse counts of features by full-batch Adam; soft targets."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((f for r in rows for f in r), np.int64, len(owner))
    w, b = np.zeros(n + 1), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = w[n] + np.bincount(owner, w[feature], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.append(np.bincount(feature, error[owner], n), error.sum()) / len(rows)
        grad[:n] += l2 * w[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:n], float(w[n])


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _batches(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield [part.column(k).to_pylist() for k in range(part.num_columns)]


def lexicon_odds(texts: DataFrame) -> tuple[list[tuple[str, float]], int, int]:
    """texts: text, toxic. Terms by odds of a toxic text to a clean one, and the two counts."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        n = [0, 0]
        for text, toxic in _batches(batches):
            for t, y in zip(text, toxic):
                n[y] += 1
                for term, _ in Counter(x for w in distinct_words(t) for x in set(terms_of(w))).items():
                    seen.setdefault(term, [0, 0])[y] += 1
        rows = [("", *n)] + [(t, *c) for t, c in seen.items()]
        for i in range(0, len(rows), 50_000):
            columns = list(zip(*rows[i : i + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["term", "clean", "toxic"])

    counts = texts.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "terms")
    total = counts.where("term = ''").first()
    if not total or not total["toxic"] or not total["clean"]:
        return [], *((total["clean"], total["toxic"]) if total else (0, 0))
    odds = (F.col("toxic") / total["toxic"]) / ((F.col("clean") + 0.5) / total["clean"])
    found = (
        counts.where((F.col("term") != "") & (F.col("toxic") >= LEAST_TEXTS))
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("toxic"), F.desc("odds"), "term")
        .limit(TERMS)
        .collect()
    )
    return [(r["term"], r["odds"]) for r in found], total["clean"], total["toxic"]


def _votes(voters: Voters, features: dict[str, int]):
    """(doc_id, tie, mask, features): a text's votes, and its terms that are features, ascending, one for
    each word that has them. Remembers what words give within bounds."""

    def run(batches):
        memory: dict[str, tuple[str, list[int]]] = {}
        for docs, ties, texts in _batches(batches):
            if len(memory) > _MEMORY:
                memory.clear()
            masks, found = [], []
            for t in texts:
                words: dict[str, list[int]] = {}
                for raw in set((t or "").lower().split()):
                    known = memory.get(raw)
                    if known is None:
                        w = _EDGE.sub("", raw)
                        known = memory[raw] = (w, [features[x] for x in terms_of(w) if x in features] if w else [])
                    if known[0]:
                        words[known[0]] = known[1]
                masks.append(voters.mask(words.keys()))
                found.append(sorted(f for fs in words.values() for f in fs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ties, pa.int64()), pa.array(masks, pa.int32()), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "tie", "mask", "features"],
            )

    return run


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row of df: doc_id, held_out, score, predicted.

    A null text counts as empty. Labels are learned only from rows of folds other than HELD_OUT;
    labels that contradict each other for an identifier count as toxic, null labels as none. Rows that
    repeat an identifier and its text count once in what is learned; other columns aren't read.
    Without toxic and clean labelled texts, or telling terms, every score is 0. An empty table gives
    no rows.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(text_col).alias("text"))
    learn = F.coalesce(fold(), F.lit(HELD_OUT)) != HELD_OUT
    marks = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # At most LABELLED_ROWS rows of three numbers: small enough to broadcast by construction.
    chosen = hash_sample(texts.select("doc_id", "tie").join(marks, "doc_id").distinct(), LABELLED_ROWS, "doc_id", "tie")
    known = texts.join(F.broadcast(chosen), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"])
    known = materialize(known.select("doc_id", "tie", "text", "toxic"), "labelled")
    odds, _, _ = lexicon_odds(known.select("text", "toxic"))
    held_out = (F.coalesce(fold(), F.lit(-1)) == HELD_OUT).alias("held_out")
    if not odds:
        return texts.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    voters, features = voters_from(odds), {t: i for i, (t, _) in enumerate(odds)}
    kinds = "doc_id long, tie long, mask int, features array<int>"
    votes = materialize(texts.mapInArrow(_votes(voters, features), kinds), "votes")

    # Two to the power of the voters bounds what is collected, however many documents there are.
    seen = votes.join(F.broadcast(chosen), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"]).groupBy("mask", "toxic").count().orderBy("mask", "toxic").collect()
    start = np.full((voters.count, 2), 1.0)
    sums = np.array([2.0, 2.0])
    for r in seen:
        start[:, r["toxic"]] += r["count"] * bits(np.array([r["mask"]]), voters.count)[0]
        sums[r["toxic"]] += r["count"]
    patterns = votes.groupBy("mask").count().orderBy("mask").collect()
    masks, counts = (np.array([r[k] for r in patterns], np.int64) for k in (0, 1))
    model = fit_label_model(masks, counts.astype(float), voters.count, np.clip(start / sums, 1e-4, 1 - 1e-4), sums[1] / sums.sum())

    rows = hash_sample(votes.where(learn).dropDuplicates(["doc_id", "tie"]), TRAIN_ROWS, "doc_id", "tie").collect()
    target = model.posterior(bits(np.array([r["mask"] for r in rows], np.int64), voters.count)) if rows else np.empty(0)
    weights, bias = fit_linear([r["features"] for r in rows], target, len(features)) if rows else (np.zeros(len(features)), -20.0)
    weight = F.array(*[F.lit(float(w)) for w in weights])  # at most TERMS numbers
    z = F.aggregate("features", F.lit(float(bias)), lambda total, f: total + F.element_at(weight, f + 1))
    score = (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias("score")
    return votes.select("doc_id", held_out, score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
