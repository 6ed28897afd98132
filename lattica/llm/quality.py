"""Quality classifier: a sparse ensemble of rules over text statistics, scored as one Spark column.

Statistics are built-in Spark functions of the text. On a bounded sample of labelled rows (`SAMPLE_ROWS`, chosen by a
hash of the id, outside the held-out fold) small boosted trees are grown in numpy; every path from a root to a node is
a conjunctive rule. A lasso-penalised logistic regression keeps few of the rules, and those compile into a column
expression, so whole texts are scored in the JVM without a shuffle. Labels, lang, source and ids are no inputs.

Rows: a null text counts as empty; every row gives a row, with a score for empty texts too. A null id counts as empty
text in the fold. Without labels of both kinds the score is the labels' mean (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import in_fold, labelled_sample

SAMPLE_ROWS, TREES, DEPTH, BINS, LASSO, PREDICT = 8000, 40, 3, 32, 0.002, 0.3
FOLD = (5, 0)


def statistics(text: str = "text") -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.length(t), F.lit(1)).cast("double")
    less = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    white = " \t\n\x0b\f\r"
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = F.split(t, "\n")
    tokens = F.split(t, r"[\x20\x09-\x0D]+")
    return {
        "words": words.cast("double"),
        "chars_per_word": (F.length(t) - less(white)) / F.greatest(words, F.lit(1)).cast("double"),
        "symbols": less("#*$%&|<>") / size,
        "bars": less("|") / size,
        "stops": less(".") / size,
        "commas": less(",") / size,
        "digits": less("0123456789") / size,
        "capitals": less("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        "wide": (F.octet_length(t) - F.length(t)) / size,
        "line_chars": size / F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "distinct_words": F.size(F.array_distinct(tokens)) / F.size(tokens).cast("double"),
    }


@dataclass
class Rule:
    """All of (statistic, above, threshold) hold: value > threshold if above, else value <= threshold."""

    parts: tuple[tuple[str, bool, float], ...]

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[n] > t if above else x[n] <= t for n, above, t in self.parts])

    def column(self) -> Column:
        out = None
        for n, above, t in self.parts:
            c = F.col(n) > F.lit(t) if above else F.col(n) <= F.lit(t)
            out = c if out is None else out & c
        return out


def _grow(bins: np.ndarray, edges: list[np.ndarray], names: list[str], residual: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, out: np.ndarray, rate: float) -> None:
    """A regression tree on binned statistics; adds each node's path to the rules and its mean to `out`."""
    if path:
        rules.add(path)
    best = None
    total, n = residual[rows].sum(), len(rows)
    if depth and n >= 40:
        for j in range(bins.shape[1]):
            b = bins[rows, j]
            s = np.cumsum(np.bincount(b, weights=residual[rows], minlength=len(edges[j]) + 1))[:-1]
            c = np.cumsum(np.bincount(b, minlength=len(edges[j]) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((c >= 20) & (n - c >= 20), s**2 / c + (total - s) ** 2 / (n - c), -1)
            if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > total**2 / n + 1e-9 and (best is None or gain[k] > best[0]):
                best = gain[k], j, k
    if best is None:
        out[rows] += rate * total / max(n, 1)
        return
    _, j, k = best
    below = bins[rows, j] <= k
    for side in (True, False):
        _grow(bins, edges, names, residual, rows[below == side], depth - 1, (*path, (names[j], not side, float(edges[j][k]))), rules, out, rate)


def extract(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Rules from the paths of boosted trees, each grown on a random half of the rows."""
    names, rng = list(x), np.random.default_rng(42)
    edges = [np.unique(np.quantile(x[n], np.arange(1, BINS) / BINS)) for n in names]
    bins = np.stack([np.searchsorted(e, x[n], "left") for e, n in zip(edges, names, strict=True)], 1)  # bin <= k as value <= edge k
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: set[tuple] = set()
    for _ in range(trees):
        step = np.zeros(len(y))
        rows = np.sort(rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 80))])
        _grow(bins, edges, names, y - 1 / (1 + np.exp(-score)), rows, depth, (), rules, step, 1.0)
        score += step
    return [Rule(p) for p in sorted(rules)]


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on the weights, by accelerated proximal gradient."""
    n, k = z.shape
    mean = z.mean(0)
    c = z - mean
    v = np.ones(k) / np.sqrt(max(k, 1))
    for _ in range(20):
        v = c.T @ (c @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * n / (float(np.linalg.norm(c @ v)) ** 2 + n)
    w = u = np.zeros(k)
    b = ub = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(c @ u + ub, -30, 30))) - y
        new = u - rate * (c.T @ err) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = ub - rate * err.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b - float(mean @ w)


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> RuleModel:
    y = np.asarray(y, float)
    if len(np.unique(y)) < 2:
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel([], [], float(np.log(p / (1 - p))))
    rules = extract(x, y)
    if not rules:
        return RuleModel([], [], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso(np.stack([r.of(x) for r in rules], 1).astype(float), y)
    kept = np.flatnonzero(w)
    return RuleModel([rules[k] for k in kept], [float(w[k]) for k in kept], float(b))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleModel:
    stats = statistics()
    got = labelled_sample(docs, labels, "quality", rows).select("doc_id", "y", *(c.alias(n) for n, c in stats.items())).orderBy("doc_id").toArrow()
    return fit({n: got.column(n).to_numpy() for n in stats}, got.column("y").to_numpy())


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = statistics()
    got = docs.select("doc_id", *(c.alias(n) for n, c in stats.items()))
    return got.select("doc_id", in_fold("doc_id", *FOLD).alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
