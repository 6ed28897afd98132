"""Toxicity: two class-conditional Kneser-Ney models of word bigrams over one shared backoff.

Both models are fitted on equally many toxic and ordinary labelled documents (at most `SAMPLE_ROWS` of each, outside
the held-out fold). A class counts a bigram by its tokens, and a word, like each of its beginnings of `STEMS`
characters, by its distinct bigrams. `DISCOUNT` is taken from every count, and what that frees goes to the next
shorter form: bigram, word, stems, and at last counts shared by both classes. An expression that a class has seen a few
times only is thus judged by its stem (inflected insults) or, failing that, by the counts that the classes share: these
are kept for the `SHARED` most frequent forms of each length, and rarer ones take the average of all that are left. A text is read in
passages of `PASSAGE` words: the two log-likelihoods of a passage, divided by its length, are compared, and the text's
evidence is its worst passage, its mean, and the mean of what exceeds `EXCESS`, plain and weighed by the root of its length.
A logistic calibration on a third of the sample that the counts don't use turns evidence into a probability at the
labels' own rate. Scoring runs in Arrow batches over whole texts without a shuffle.

Counts are made by Spark; the driver receives at most `SHARED` forms of each length and the n-grams above the discount,
which the sample's size bounds.

Rows: null and empty texts have no passage and zero evidence. Every row gives a row. A null id counts as empty text in
the fold. Without labels of both kinds, the score is 1 or 0 as the labels are (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, boxed, in_fold, mix, save, slices, unboxed

SAMPLE_ROWS, DISCOUNT, PASSAGE, PREDICT = 3000, 3.0, 6, 0.5
STEMS, EXCESS, SHARED = (3, 4, 5, 6), 1.0, 1 << 16
FOLD = (5, 0)
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Reading(Words):
    """A block's words, lower-cased and without marks at their ends, each with the word before it (0: a text's first)."""

    def __init__(self, texts: list[bytes]):
        super().__init__([t.lower() for t in texts])
        self.word = self.trimmed(MARKS)
        self.forms = [*(self.trimmed(MARKS, characters=k) for k in STEMS), self.word]
        self.before = np.zeros_like(self.word)
        self.before[1:] = np.where(self.doc[1:] == self.doc[:-1], self.word[:-1], 0)
        self.pair = mix(self.before * _A + self.word * _B)


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class KneserNey:
    """Arrays of two columns hold the ordinary and the toxic class; forms: from the shortest stem to the word."""

    form: list[np.ndarray]
    form_n: list[np.ndarray]
    form_cut: list[np.ndarray]
    form_rest: list[float]
    total: np.ndarray
    context: np.ndarray
    context_n: np.ndarray
    context_cut: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray
    weights: np.ndarray

    def ratio(self, r: Reading) -> np.ndarray:
        """Of each word, log P(word | before, toxic) - log P(word | before, ordinary)."""
        u, first, inverse = np.unique(r.word, return_index=True, return_inverse=True)
        p, above = np.ones((len(u), 2)), np.full(len(u), self.total.sum())
        for form, n, cut, rest, hashes in zip(self.form, self.form_n, self.form_cut, self.form_rest, r.forms, strict=True):
            at, known = _at(form, hashes[first])
            own = np.where(known[:, None], n[at], 0.0) if len(form) else np.zeros((len(u), 2))
            both = np.where(known, own.sum(1), rest)
            share = (both + 0.5) / (above + 1.0)
            p = (np.maximum(own - DISCOUNT, 0) + cut * p * share[:, None]) / np.maximum(self.total, 1)
            above = both
        cat, seen = _at(self.context, u)
        p = p[inverse]
        has = np.zeros(len(r.word), bool)
        has[1:] = (r.before[1:] != 0) & seen[inverse[:-1]]
        rows = np.flatnonzero(has)
        if len(rows):
            c = cat[inverse[rows - 1]]
            pat, there = _at(self.pair, r.pair[rows])
            own = np.where(there[:, None], np.maximum(self.pair_n[pat] - DISCOUNT, 0), 0.0) if len(self.pair) else 0.0
            total, cut = self.context_n[c], self.context_cut[c]
            p[rows] = np.where(total > 0, (own + cut * p[rows]) / np.maximum(total, 1), p[rows])
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def evidence(self, r: Reading) -> np.ndarray:
        """(texts, 4): of the words' log ratios, the largest passage mean, the mean, the mean of what exceeds `EXCESS`, and
        that mean times the root of the words."""
        out = np.zeros((r.n, 4))
        if not len(r.word):
            return out
        ratio = self.ratio(r)
        s = np.concatenate([[0], np.cumsum(ratio)])
        first = np.concatenate([[0], np.cumsum(r.count)])[:-1]
        some = np.flatnonzero(r.count)
        out[some, 1] = (s[first[some] + r.count[some]] - s[first[some]]) / r.count[some]
        out[:, 2] = np.bincount(r.doc, weights=np.maximum(ratio - EXCESS, 0), minlength=r.n) / np.maximum(r.count, 1)
        out[:, 3] = out[:, 2] * np.sqrt(r.count)
        end = np.minimum(np.arange(len(ratio)) + PASSAGE, (first + r.count)[r.doc])
        begin = np.maximum(np.minimum(np.arange(len(ratio)), end - PASSAGE), first[r.doc])  # a text's last passages are whole
        out[some, 0] = np.maximum.reduceat((s[end] - s[begin]) / (end - begin), first[some])
        return out

    def score(self, r: Reading) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(r) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Logistic weights of the evidence, by Newton steps on balanced classes, moved to the labels' rate."""
    z = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    k = z.shape[1]
    pull = np.array([1e-2] * (k - 1) + [0.0])
    w = np.zeros(k)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + pull * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-6)
        w = w - np.linalg.solve(h, g)
    w[-1] += np.log(rate / (1 - rate))
    return w


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """(doc_id, y, count, text) of the balanced sample, `count` marking rows for counts; and the toxic rate of all labels."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold("doc_id", *FOLD)).groupBy("doc_id").agg(F.max("y").alias("y"))
    rate = own.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = own.filter("y = 1").orderBy(*order).limit(rows).union(own.filter("y = 0").orderBy(*order).limit(rows))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return save(text.select("doc_id", "y", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("counted"), "text"), "toxicity-sample"), 0.0 if rate is None else float(rate)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> KneserNey:
    sample, rate = _sample(docs, labels, rows)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            r = Reading(texts)
            y = part.column("y").to_numpy(zero_copy_only=False)[r.doc]
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (r.before, r.pair, *r.forms))], names=["y", "v", "pair", *forms])

    forms = [*(f"s{k}" for k in STEMS), "w"]
    longs = ", ".join(f"{n} long" for n in ("v", "pair", *forms))
    base = save(sample.filter("counted").select("y", "text").mapInArrow(grams, f"y int, {longs}").groupBy("v", "pair", *forms).agg(*(F.sum((F.col("y") == k).cast("double")).alias(f"n{k}") for k in (0, 1))), "toxicity-grams")
    two = lambda df, *cols: np.column_stack([df.column(c).to_numpy() for c in cols]).astype(float).reshape(-1, 2)
    key = lambda df, c: df.column(c).to_numpy().view(np.uint64)
    above = lambda: F.greatest("n0", "n1") > DISCOUNT
    form, form_n, form_cut, form_rest, total = [], [], [], [], np.zeros(2)
    for name in forms:
        by = base.groupBy(name).agg(F.sum((F.col("n0") > 0).cast("double")).alias("n0"), F.sum((F.col("n1") > 0).cast("double")).alias("n1"))
        sums = by.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("n0", "n1")), *(F.coalesce(F.sum(F.least(c, F.lit(DISCOUNT))), F.lit(0.0)) for c in ("n0", "n1")), F.count(F.lit(1))).first()
        top = by.orderBy(F.desc(F.greatest("n0", "n1") > DISCOUNT), F.desc(F.col("n0") + F.col("n1")), name).limit(SHARED).toArrow()
        order = np.argsort(key(top, name))
        form.append(key(top, name)[order]), form_n.append(two(top, "n0", "n1")[order]), form_cut.append(np.array(sums[2:4]))
        form_rest.append(max(sum(sums[:2]) - float(form_n[-1].sum()), 0.0) / (sums[4] - len(order)) if sums[4] > len(order) else 0.0)
        total = np.array(sums[:2])
    pair = base.groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(above()).toArrow()
    context = base.groupBy("v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *(F.sum(F.least(f"n{k}", F.lit(DISCOUNT))).alias(f"c{k}") for k in (0, 1)), F.max(F.greatest("n0", "n1")).alias("most")).filter(F.col("most") > DISCOUNT).toArrow()
    b, c = (np.argsort(key(t, n)) for t, n in ((context, "v"), (pair, "pair")))
    model = KneserNey(
        form, form_n, form_cut, form_rest, total, key(context, "v")[b], two(context, "n0", "n1")[b], two(context, "c0", "c1")[b], key(pair, "pair")[c], two(pair, "n0", "n1")[c],
        np.array([0.0] * 4 + [-30.0 if rate < 0.5 else 30.0]),
    )
    if not 0 < rate < 1 or not (model.total > 0).all():
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            e = shared.value.evidence(Reading(texts))
            yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array(e[:, k]) for k in range(4))], names=["y", *"abcd"])

    got = sample.filter("not counted").select("y", "text").mapInArrow(weigh, "y int, a double, b double, c double, d double").orderBy("y", *"abcd").toArrow()
    y = got.column("y").to_numpy()
    if len(np.unique(y)) == 2:
        model.weights = calibrate(np.column_stack([got.column(n).to_numpy() for n in "abcd"]), y, rate)
    return model


def score(docs: DataFrame, model: KneserNey, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; or the columns of `keep` and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = keep or ["doc_id"]
    fields = {f.name: f.dataType.simpleString() for f in docs.select(*names).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(shared.value.score(Reading(texts)))], names=[*names, "score"])

    out = docs.select(*names, *(["text"] if "text" not in names else [])).mapInArrow(run, ", ".join(f"`{n}` {fields[n]}" for n in names) + ", score double")
    if keep:
        return out
    return out.select("doc_id", in_fold("doc_id", *FOLD).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' own columns, without those scored as toxic."""
    return unboxed(score(boxed(docs), train(docs, labels), ["text", "row"]).filter(F.col("score") < PREDICT), docs)
