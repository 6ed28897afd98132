"""Language-model scoring with a log-bilinear neural model trained in numpy by noise-contrastive estimation.

Every pass covers all training documents. (1) Tokens are counted: each task pre-aggregates its own, keyed by a 64-bit
token hash (with V distinct tokens, V^2 / 2^65 pairs are expected to share one). (2) The model predicts a symbol from
the two before it; symbols are the most frequent tokens (at most `SYMBOLS`) and, for all others, classes by surface
form. The documents' symbols are written as a table of rounds; training visits every position once. In a round, trainers
to which documents are dealt by their row ids go on from the previous round's parameters, and these are averaged by
positions after it. A trainer has `TASK` positions a round, so the trainers' number follows the corpus, and so does the
number of rounds up to `MOST_ROUNDS` (`schedule`): neither a task nor the driver's part grows, and the layout of files
plays no part. (3) Two matrix products turn the parameters into score tables and one more into the normaliser of every
context, so token log-probabilities are exact look-ups; a token of a class shares the class's probability by its add-one
count.

What tasks receive is bounded: `DICTIONARY` token counts and `SYMBOLS`^2 scores. Counts of all other tokens stay in a
distributed table; the documents' rare tokens meet it in a join.

Rows: null or empty text is the end token alone. A null id counts as empty text in the fold. Repeated documents each
count and each get a row; with no training document, every token is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, drop, in_fold, keyed, save, slices

SYMBOLS, CLASSES, DICTIONARY = 2048, 16, 1 << 19
WIDTH, NOISE, SHARED_NOISE, BATCH, RATE = 24, 8, 128, 2048, 0.05
ROUNDS, MOST_ROUNDS, TASK, FEW = 4, 16, 1 << 22, 64
HELD_OUT = (7, 2)
END = np.array([0x5BF0_3635_16E5_A1C3], dtype=np.uint64)


class Tokens(Words):
    """The tokens of a block: words, and one end after each text."""

    def __init__(self, texts: list[bytes]):
        super().__init__([t.lower() for t in texts])
        at = np.cumsum(self.count)  # where each text's end goes
        self.hash = np.insert(self.hashes(), at, END[0])
        size = self.end - self.start
        last = self.buf[np.maximum(self.end - 1, 0)] if len(size) else np.zeros(0, np.uint8)
        kind = np.select([last == ord(","), last == ord("."), last >= 0x80], [1, 2, 0], np.where((last >= 97) & (last <= 122), 0, 3))
        wide = np.concatenate([[0], np.cumsum(self.buf >= 0x80)])
        form = kind * 4 + (wide[self.end] > wide[self.start]) * 2 + (size > 8)
        self.form = np.insert(form.astype(np.int8), at, 0)
        self.tokens = self.count + 1
        self.text = np.repeat(np.arange(self.n), self.tokens)


def counts(docs: DataFrame, fold: tuple[int, int] = HELD_OUT) -> DataFrame:
    """(h, form, c): each training token's hash, surface class and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            h, form, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(form[first]), pa.array(np.bincount(inverse, weights=c).astype(np.int64))], names=["h", "form", "c"])

        for _, texts in slices(batches):
            t = Tokens(texts)
            u, first, c = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((u, t.form[first], c))
            size += len(u)
            if size > 2_000_000:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    train = docs.filter(~in_fold("doc_id", *fold)).select("text")
    return train.mapInArrow(run, "h long, form byte, c long").groupBy("h").agg(F.min("form").alias("form"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks need to know of the counts: totals, those of the most frequent tokens, and which are symbols."""

    n: int
    v: int
    hash: np.ndarray  # sorted
    count: np.ndarray
    symbol: np.ndarray  # of each dictionary token: its symbol, or -1 if it has none of its own
    class_n: np.ndarray
    class_v: np.ndarray
    end: int

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its count (-1: not in the dictionary), its symbol, whether it only has a class."""
        u, inverse = np.unique(t.hash, return_inverse=True)
        if not len(self.hash):
            return np.full(len(t.hash), -1), t.form.astype(np.int64), np.ones(len(t.hash), bool)
        at = np.minimum(np.searchsorted(self.hash, u), len(self.hash) - 1)
        found = self.hash[at] == u
        c = np.where(found, self.count[at], -1)[inverse]
        s = np.where(found, self.symbol[at], -1)[inverse]
        return c, np.where(s < 0, t.form, s), s < 0


def vocabulary(table: DataFrame, symbols: int = SYMBOLS, most: int = DICTIONARY) -> tuple[Vocabulary, int]:
    """From the count table; and the least count of the dictionary's tokens."""
    octave = F.floor(F.log2("c") * 16).cast("int")
    steps = table.groupBy(octave.alias("k")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).orderBy(F.desc("k")).collect()  # at most 16 * 64 rows
    total, taken, least = 0, 0, 1 << 62
    for r in steps:
        taken += r["v"]
        if taken > most:
            break
        least = r["least"]
    total = sum(r["n"] for r in steps)
    top = table.filter(F.col("c") >= least).select("h", "form", "c").toArrow()
    h, form, c = (top.column(i).to_numpy() for i in range(3))
    order = np.lexsort((h, -c))
    end = np.flatnonzero(h[order].view(np.uint64) == END[0]) if len(h) else np.zeros(0, np.int64)
    own = [*order[end].tolist(), *(i for i in order[: symbols - CLASSES].tolist() if i not in set(order[end].tolist()))][: symbols - CLASSES]
    symbol = np.full(len(h), -1, np.int64)
    symbol[own] = CLASSES + np.arange(len(own))
    by = {r["form"]: r for r in table.groupBy("form").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    class_n, class_v = (np.array([by[k][x] if k in by else 0 for k in range(CLASSES)], np.int64) for x in ("n", "v"))
    np.subtract.at(class_n, form[own].astype(int), c[own])
    np.subtract.at(class_v, form[own].astype(int), 1)
    by_hash = np.argsort(h.view(np.uint64))
    return Vocabulary(total, sum(r["v"] for r in steps), h.view(np.uint64)[by_hash], c[by_hash], symbol[by_hash], class_n, class_v, CLASSES if len(end) else 0), least


def _gather(at: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of g by their places."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.diff(places, prepend=-1))
    out = np.zeros((size, g.shape[1]), np.float32)
    out[places[first]] = np.add.reduceat(g[order], first, axis=0)
    return out


@dataclass
class LogBilinear:
    """Score of symbol w after (x, y): (word[x] @ place[0] + word[y] @ place[1]) . target[w] + bias[w]."""

    word: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray
    seen: int = 0

    @classmethod
    def start(cls, unigram: np.ndarray, width: int = WIDTH) -> LogBilinear:
        r = np.random.default_rng(42)
        draw = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(len(unigram), width), draw(len(unigram), width), np.stack([np.eye(width, dtype=np.float32)] * 2), np.log(unigram).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.word, self.target, self.place, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray, symbols: int, width: int = WIDTH) -> LogBilinear:
        a, b, c = np.split(flat, np.cumsum([symbols * width, symbols * width, 2 * width * width]))[:3]
        return cls(a.reshape(symbols, width), b.reshape(symbols, width), c.reshape(2, width, width), flat[-symbols:])

    def train(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, noise: np.ndarray, rng: np.random.Generator, state: list[np.ndarray]) -> None:
        """One noise-contrastive AdaGrad step; the noise symbols are drawn once for the minibatch and weighted."""
        n, k, size = len(w), SHARED_NOISE, len(self.bias)
        drawn = np.searchsorted(np.cumsum(noise), rng.random(k)).clip(0, size - 1)
        expected = np.log(NOISE * noise).astype(np.float32)
        q = (self.word @ self.place[0])[x] + (self.word @ self.place[1])[y]
        aim = self.target[w]
        data = np.einsum("ij,ij->i", q, aim) + self.bias[w] - expected[w]
        false = q @ self.target[drawn].T + (self.bias[drawn] - expected[drawn])
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        up, down = ((1 - sigmoid(data)) / n).astype(np.float32), sigmoid(false) * np.float32(NOISE / k / n)
        g_q = up[:, None] * aim - down @ self.target[drawn]
        g_target = _gather(w, up[:, None] * q, size)
        np.subtract.at(g_target, drawn, down.T @ q)
        g_bias = (np.bincount(w, weights=up, minlength=size) - np.bincount(drawn, weights=down.sum(0), minlength=size)).astype(np.float32)
        g1, g2 = _gather(x, g_q, size), _gather(y, g_q, size)
        g_word = g1 @ self.place[0].T + g2 @ self.place[1].T
        g_place = np.stack([self.word.T @ g1, self.word.T @ g2])
        for value, g, s in zip(self.parts(), (g_word, g_target, g_place, g_bias), state, strict=True):
            s += g * g
            value += np.float32(RATE) * g / np.sqrt(s)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one, two, log_z): log P(w | x, y) = one[x, w] + two[y, w] - log_z[x, y], normalised over all symbols."""
        one = self.word @ self.place[0] @ self.target.T
        two = self.word @ self.place[1] @ self.target.T + self.bias
        a, b = one.max(1, keepdims=True), two.max(1, keepdims=True)
        log_z = np.log(np.exp(one - a) @ np.exp(two - b).T) + (a + b.T)
        return one, two, log_z


def contexts(text: np.ndarray, symbol: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols before each token; before a text's first token stand ends."""
    x, y = np.full(len(symbol), end, np.int64), np.full(len(symbol), end, np.int64)
    if len(symbol) > 1:
        y[1:] = np.where(text[1:] == text[:-1], symbol[:-1], end)
    if len(symbol) > 2:
        x[2:] = np.where(text[2:] == text[:-2], symbol[:-2], end)
    return x, y


def schedule(positions: int, task: int = TASK) -> tuple[int, int]:
    """(rounds, trainers) for so many positions."""
    tasks = -(-positions // task)
    rounds = min(max(ceil(tasks**0.5), ROUNDS), MOST_ROUNDS)
    return rounds, max(-(-tasks // rounds), 1)


def _symbols(train: DataFrame, shared: Broadcast) -> DataFrame:
    """round, part, rid, s (symbols) of every document, a table in folders of rounds. train: round, part, rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            t = Tokens(texts)
            ends = np.concatenate([[0], np.cumsum(t.tokens)]).astype(np.int32)
            s = pa.ListArray.from_arrays(pa.array(ends), pa.array(shared.value.look_up(t)[1].astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("round", "part", "rid")] + [s], names=["round", "part", "rid", "s"])

    return save(train.select("round", "part", "rid", "text").mapInArrow(run, "round int, part int, rid long, s array<short>"), "lm-symbols", "round")


def fit(docs: DataFrame, vocab: Vocabulary, fold: tuple[int, int] = HELD_OUT, task: int = TASK) -> LogBilinear:
    """The model after all rounds; docs: rid, doc_id, text. `seen` is the number of positions it was trained on."""
    spark = docs.sparkSession
    own = vocab.symbol >= 0
    size = CLASSES + int(own.sum())
    unigram = np.zeros(size)
    unigram[:CLASSES] = vocab.class_n
    unigram[vocab.symbol[own]] = vocab.count[own]
    unigram = (unigram + 1) / (unigram.sum() + size)
    model = LogBilinear.start(unigram)
    state = np.full_like(model.flat(), 1e-8)
    rounds, trainers = schedule(vocab.n, task)
    at = F.pmod(F.xxhash64("rid"), F.lit(rounds * trainers)).cast("int")
    dealt = docs.filter(~in_fold("doc_id", *fold)).select("rid", "text").withColumn("at", at)
    dealt = dealt.select((F.col("at") % rounds).alias("round"), F.floor(F.col("at") / rounds).cast("int").alias("part"), "rid", "text")
    table = _symbols(dealt, spark.sparkContext.broadcast(vocab))
    seen = 0
    for k in range(rounds):
        part = table.filter(F.col("round") == k).repartitionById(trainers, "part").sortWithinPartitions("rid").select("s")
        trained = part.mapInArrow(_trainer(k, vocab.end, unigram, spark.sparkContext.broadcast((model.flat(), state))), "n double, flat binary")
        if trainers > FEW:  # then the driver gets the means of groups of trainers
            trained = trained.repartition(ceil(trainers**0.5)).mapInArrow(_means, "n double, flat binary")
        n, both = _mean((r["n"], r["flat"]) for r in trained.collect())  # at most FEW rows, or the root of the trainers' number
        if n:
            flat, state = np.split(both.astype(np.float32), 2)
            model = LogBilinear.of(flat, size)
            seen += int(n)
    drop(table)
    model.seen = seen
    return model


def _mean(rows: Iterable[tuple[float, bytes]]) -> tuple[float, np.ndarray]:
    """The number of positions, and the mean of the flat arrays weighed by them."""
    total, out = 0.0, np.zeros(0)
    for n, flat in rows:
        one = np.frombuffer(flat, np.float32) * np.float64(n)
        total, out = total + n, one if not total else out + one
    return total, out / max(total, 1.0)


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, both = _mean(pair for b in batches for pair in zip(b.column("n").to_pylist(), b.column("flat").to_pylist(), strict=True))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.astype(np.float32).tobytes()], pa.binary())], names=["n", "flat"])


def _trainer(k: int, end: int, unigram: np.ndarray, before: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a round's trainers, each a partition of documents' symbols: positions seen, and parameters and AdaGrad sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sums = (x.copy() for x in before.value)
        model, state = LogBilinear.of(flat, len(unigram)), LogBilinear.of(sums, len(unigram)).parts()
        rng = np.random.default_rng((7, k, TaskContext.get().partitionId()))
        held: list[np.ndarray] = []
        seen = waiting = 0
        for batch in batches:
            for row in range(0, len(batch), 64):
                s = batch.column("s").slice(row, 64)
                text = np.repeat(np.arange(len(s)), np.diff(s.offsets.to_numpy()))
                symbol = s.flatten().to_numpy().astype(np.int64)
                held.append(np.stack([*contexts(text, symbol, end), symbol]))
                waiting += len(symbol)
                if waiting >= 64 * BATCH:
                    seen, waiting = seen + _steps(model, np.concatenate(held, 1), unigram, rng, state), 0
                    held.clear()
        if held:
            seen += _steps(model, np.concatenate(held, 1), unigram, rng, state)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([np.concatenate([flat, sums]).tobytes()], pa.binary())], names=["n", "flat"])

    return run


def _steps(model: LogBilinear, triples: np.ndarray, noise: np.ndarray, rng: np.random.Generator, state: list[np.ndarray]) -> int:
    order = rng.permutation(triples.shape[1])
    for i in range(0, len(order), BATCH):
        model.train(*triples[:, order[i : i + BATCH]], noise, rng, state)
    return len(order)


def score(docs: DataFrame, fold: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = keyed(docs, label="lm-keyed")
    spark = docs.sparkSession
    table = save(counts(docs, fold), "lm-counts")
    vocab, least = vocabulary(table)
    model = fit(docs, vocab, fold)
    log_d = np.log10(vocab.n + vocab.v + 1)
    log_class = np.log10(vocab.class_n + vocab.class_v + 1)
    shared = spark.sparkContext.broadcast((vocab, *model.tables(), log_class))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, one, two, log_z, log_class = shared.value
        for part, texts in slices(batches):
            t = Tokens(texts)
            c, symbol, classed = vocab.look_up(t)
            known = c > 0
            per = lambda weights: np.bincount(t.text, weights=weights, minlength=t.n)  # noqa: E731,B023
            own = np.log10(np.maximum(c, 0) + 1.0)
            x, y = contexts(t.text, symbol, vocab.end)
            p = (one[x, symbol].astype(np.float64) + two[y, symbol] - log_z[x, y]) / np.log(10)
            p += np.where(classed, own - log_class[np.where(classed, symbol, 0)], 0)
            rare = np.flatnonzero(c < 0)
            ends = np.concatenate([[0], np.cumsum(np.bincount(t.text[rare], minlength=t.n))]).astype(np.int32)
            cols = [part.column("rid"), part.column("doc_id"), pa.array(t.tokens.astype(np.int64)), pa.array(per(known).astype(np.int64)), pa.array(per(own) - t.tokens * log_d), pa.array(per(p)), pa.ListArray.from_arrays(pa.array(ends), pa.array(t.hash[rare].view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    scored = save(docs.mapInArrow(run, f"rid long, doc_id {id_type}, n_tokens long, n_known long, base_score double, score double, rare array<long>"), "lm-scored")
    rare = scored.select("rid", F.explode("rare").alias("h")).join(table.filter(F.col("c") < least).select("h", "c"), "h")
    more = rare.groupBy("rid").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    return scored.drop("rare").join(more, "rid", "left").select(
        "doc_id", in_fold("doc_id", *fold).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    return score(docs)
