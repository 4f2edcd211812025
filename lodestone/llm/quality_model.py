"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gives a few numbers, in one pass that writes a narrow table. Quantiles over all documents cut
each number into bins. On a bounded sample of labelled rows, shallow trees are boosted one feature after
another, round after round; a tree over one feature's bins is a step function, so the sum of a feature's
trees is a look-up table over its bins. The pairs of features whose joint cuts explain most of what is
left get tables over two features' bins, boosted in the same way. A score is the sum of the
entries that a row's bins point to.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_sample, materialize

#: At most so many labelled rows train the model: those with the smallest hash of identifier and text.
TRAIN_ROWS = 20_000
#: Bins of a feature, and of each of a pair's two.
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 60, 8, 0.1
#: Leaves of a tree, and the least weight (of p(1-p)) on each side of a cut.
LEAVES, LEAST = 4, 2.0
HELD_OUT, FOLDS = 1, 3
THRESHOLD = 0.5

FEATURES = (
    "words", "word_length", "longest_word", "short_words", "distinct_words", "commonest_word", "stutters", "repeats", "lines", "repeated_lines", "sentence_ends",
    "letters", "capitals", "capital_words", "digits", "symbols", "symbol_words", "marks", "stops", "beyond_ascii", "entropy", "deflated",
)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>@\\^~_={}\[\]]")
_DEFLATE = 1 << 16


def measures(text: str | None) -> list[float]:
    """The numbers of FEATURES; all of them 0 for an empty text but those that count."""
    text = text or ""
    words = [w for w in _SPACE.split(text) if w]
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(FEATURES)
    counts, lengths = Counter(words), [len(w) for w in words]
    windows = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = Counter(text)
    of = lambda test: sum(k for c, k in chars.items() if test(c))
    letters = of(str.isalpha)
    raw, packer = text.encode(), zlib.compressobj(1)
    deflated = sum(len(packer.compress(raw[i : i + _DEFLATE])) for i in range(0, len(raw), _DEFLATE)) + len(packer.flush())
    return [
        math.log1p(n), sum(lengths) / n, math.log1p(max(lengths)), sum(k <= 3 for k in lengths) / n, len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(windows) / max(n - 2, 1) if n > 2 else 0.0, n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(w[-1] in ".?!" for w in words) / n,
        letters / size, of(str.isupper) / max(letters, 1), sum(w.isupper() and len(w) > 1 for w in words) / n, of(str.isdigit) / size, len(_SYMBOL.findall(text)) / size,
        sum(bool(_SYMBOL.search(w)) for w in words) / n, (chars["!"] + chars["?"]) / n, (chars["."] + chars[","]) / n, of(lambda c: ord(c) > 127) / size,
        -sum(k / size * math.log2(k / size) for k in chars.values()), deflated / len(raw),
    ]


def _measured(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = np.array([measures(t) for t in part.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in rows.T)], names=["doc_id", "tie", *FEATURES])


class Model(NamedTuple):
    """intercept; a feature's edges and its table; (feature, feature, table over their coarse bins)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, columns: list[np.ndarray], edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, columns)]

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        """Probabilities: the intercept and the entries of the rows' bins, added up."""
        fine, coarse = self.bins(columns, self.edges), self.bins(columns, self.coarse)
        z = np.full(len(columns[0]), self.intercept)
        for table, at in zip(self.tables, fine):
            z += table[at]
        for a, b, table in self.pairs:
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """The best of the cuts of a row of bins in two: its gain, and the bins on the left (0: none helps)."""
    g, w = np.cumsum(gradient), np.cumsum(weight)
    left_g, left_w = g[:-1], w[:-1]
    right_g, right_w = g[-1] - left_g, w[-1] - left_w
    fits = (left_w >= LEAST) & (right_w >= LEAST)
    gain = np.where(fits, left_g**2 / (left_w + 1) + right_g**2 / (right_w + 1) - g[-1] ** 2 / (w[-1] + 1), 0.0)
    best = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[best]), best + 1) if len(gain) and gain[best] > 1e-9 else (0.0, 0)


def tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A step over the bins with so many leaves at most, grown by the best cut: its Newton steps."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        gain, at, k = max((*cut(gradient[a:b], weight[a:b]), -k) for k, (a, b) in enumerate(parts))
        if not at:
            break
        a, b = parts[-k]
        parts[-k : -k + 1] = [(a, a + at), (a + at, b)]
    out = np.empty(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """A cut by one of two features, then by the other on each side: four leaves; its gain and steps."""
    best, out = 0.0, np.zeros_like(gradient)
    for turned in (False, True):
        g, w = (gradient.T, weight.T) if turned else (gradient, weight)
        total = g.sum() ** 2 / (w.sum() + 1)
        for at in range(1, g.shape[0]):
            step, gain = np.zeros_like(g), -total
            for rows in (slice(0, at), slice(at, None)):
                gg, ww = g[rows].sum(0), w[rows].sum(0)
                _, inner = cut(gg, ww)
                for side in (slice(0, inner), slice(inner, None)) if inner else (slice(None),):
                    sg, sw = gg[side].sum(), ww[side].sum()
                    gain += sg**2 / (sw + 1)
                    step[rows, side] = sg / (sw + 1)
            if gain > best + 1e-9:
                best, out = gain, step.T if turned else step
    return best, out


def fit(columns: list[np.ndarray], y: np.ndarray, edges: list[np.ndarray], check: np.ndarray) -> Model:
    """Cyclic boosting; rows where check is true choose the number of rounds."""
    coarse = [e[np.unique(np.maximum(np.arange(1, PAIR_BINS) * (len(e) + 1) // PAIR_BINS - 1, 0))] if len(e) else e for e in edges]
    rate = np.clip(y[~check].mean() if (~check).any() else y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(math.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    fine, rough = model.bins(columns, edges), model.bins(columns, coarse)
    learn = ~check
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where(learn, y - p, 0.0), np.where(learn, np.maximum(p * (1 - p), 1e-6), 0.0)

    def loss() -> float:
        at = check if check.any() else learn
        p = np.clip(1 / (1 + np.exp(-np.clip(z[at], -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(y[at] * np.log(p) + (1 - y[at]) * np.log(1 - p)).mean())

    def boosted(tables: list[np.ndarray], rounds: int, step_of) -> list[np.ndarray]:
        nonlocal z
        best, best_z, least, since = [t.copy() for t in tables], z.copy(), loss(), 0
        for _ in range(rounds):
            for k, table in enumerate(tables):
                step, at = step_of(k)
                table += RATE * step
                z = z + RATE * step[at]
            now = loss()
            if now < least - 1e-6:
                best, best_z, least, since = [t.copy() for t in tables], z.copy(), now, 0
            else:
                since += 1
                if since > 10:
                    break
        z = best_z
        return best

    def feature(k: int):
        g, w = slopes()
        size = len(edges[k]) + 1
        return tree(np.bincount(fine[k], g, size), np.bincount(fine[k], w, size)), fine[k]

    tables = boosted([t.copy() for t in model.tables], ROUNDS, feature)

    def joint(a: int, b: int) -> tuple[float, np.ndarray]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        at = rough[a] * shape[1] + rough[b]
        g, w = slopes()
        return pair_tree(*(np.bincount(at, x, shape[0] * shape[1]).reshape(shape) for x in (g, w)))

    gains = sorted(((joint(a, b)[0], a, b) for a, b in combinations(range(len(edges)), 2)), key=lambda x: (-x[0], x[1:]))
    chosen = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    empty = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    grids = boosted(empty, PAIR_ROUNDS, lambda k: (joint(*chosen[k])[1], (rough[chosen[k][0]], rough[chosen[k][1]])))
    return model._replace(tables=tables, pairs=[(a, b, t) for (a, b), t in zip(chosen, grids)])


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def numbers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (a hash of the text) and FEATURES of every whole text."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), text.alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, tie long, " + ", ".join(f"{f} double" for f in FEATURES))


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """The model of a table of numbers(); None without labelled rows of both classes."""
    learn = F.coalesce(fold(), F.lit(HELD_OUT)) != HELD_OUT
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isNotNull() & learn)
    marks = marks.groupBy("doc_id").agg(F.min("_y").alias("_y"))
    known = measured.join(marks, "doc_id").dropDuplicates(["doc_id", "tie"])
    rows = hash_sample(known, TRAIN_ROWS, "doc_id", "tie").collect()  # TRAIN_ROWS rows of numbers at most
    y = np.array([float(r["_y"] == 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    cuts = [i / BINS for i in range(1, BINS)]
    found = measured.agg(*[F.percentile_approx(f, cuts, 1_000).alias(f) for f in FEATURES]).first()
    columns = [np.array([r[f] for r in rows]) for f in FEATURES]
    check = np.array([zlib.crc32(b"check:%d" % (r["doc_id"] or 0)) % 6 == 0 for r in rows])
    return fit(columns, y, [np.unique(np.array(found[f])) for f in FEATURES], check if 0 < check.sum() < len(check) else np.zeros(len(y), bool))


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            columns = [batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(columns), pa.float64())], names=["doc_id", "score"])

    return run


def lookup_tables(spark, model: Model) -> DataFrame:
    """What the model adds: feature, the bin's lower edge (null: none) and the entry; as many rows as bins."""
    rows = [(f, float(e) if e is not None else None, float(v)) for f, edges, t in zip(FEATURES, model.edges, model.tables) for e, v in zip([None, *edges], t)]
    return spark.createDataFrame(rows, "feature string, at_least double, adds double")


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of df: doc_id, held_out, score, predicted.

    A null text counts as empty, whose numbers are all 0. Labels are learned only from rows of folds other
    than HELD_OUT; labels that contradict each other for an identifier count as 0, null labels as none.
    Rows that repeat an identifier and its text count once in what is learned, and each has its
    score; texts alike score alike. Other columns aren't read. Without labelled rows of both classes every
    score is 0.5. An empty table gives no rows.
    """
    measured = materialize(numbers(df, id_col, text_col), "measures")
    model = train(measured, labels, id_col, label_col)
    if model is None:
        scored = measured.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = measured.select("doc_id", *FEATURES).mapInArrow(_scored(model), "doc_id long, score double")
    held_out = F.coalesce(fold(), F.lit(-1)) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
