"""Quality rules: counted text measures, a base rule on them, and a hashed n-gram logistic model for the verdict.

The model takes hashed word 1-grams, word 2-grams and character 3-grams; a document's logit is the sum over the three kinds
of the mean weight of its n-grams, so length does not matter. It is fitted in numpy on a bounded sample of labelled
rows (at most `SAMPLE_ROWS` of them and, as their texts are sent to the driver, `SAMPLE_BYTES` of text), its logits are turned into probabilities by a logistic calibration on a fifth of that sample, and
whole texts are scored in Arrow batches against the fixed `KEEP` threshold. A lost executor costs its batches only.

Rows: a null text has no words and fails the base rule. Every row gives a row. Without labels of both kinds the model
keeps whatever the base rule passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lattica.llm.common import Words, labelled_sample, mix, slices

SAMPLE_ROWS, SAMPLE_BYTES, HASH_BITS, KEEP, EPOCHS = 4000, 64_000_000, 16, 0.3, 60
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_ODD = np.array([0x9E3779B97F4A7C15 + 2 * k * 0x51ED270B0F for k in range(1, 9)], dtype=np.uint64) | np.uint64(1)


def measures(texts: list[bytes], words: Words | None = None, hashes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words or Words(texts)
    h = w.hashes() if hashes is None else hashes
    of = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)[w.doc_end - 1]])) if w.n else np.zeros(0, np.int64)
    out = {"n_words": w.count, "word_chars": of(w.black & ((w.buf & 0xC0) != 0x80)), "n_symbols": of(SYMBOLS[w.buf])}
    dup = np.zeros(w.n, np.int64)
    for i, t in enumerate(texts):
        seen: set[bytes] = set()
        for line in t.split(b"\n"):
            if line in seen:
                dup[i] += 1
            elif line and not line.isspace():
                seen.add(line)
    out["n_dup_lines"] = dup
    hit = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 8:
        win = np.zeros(len(h) - 7, np.uint64)
        for j in range(8):
            win += h[j : len(h) - 7 + j] * _ODD[j]
        inside = np.flatnonzero(w.doc[:-7] == w.doc[7:])
        key = mix(win[inside] + mix(w.doc[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + 8, -1)
    covered = np.cumsum(hit)[: len(h)] > 0
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=w.n)
    return out


def features(w: Words, h: np.ndarray, bits: int = HASH_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slot, text number) of every n-gram, by kind; the kinds share the slots of one table three times as long."""
    shift, slots = np.uint64(64 - bits), 1 << bits
    kinds = [((h >> shift).astype(np.int32), w.doc)]
    two = np.flatnonzero(w.doc[:-1] == w.doc[1:]) if len(h) > 1 else np.zeros(0, np.int64)
    kinds.append(((mix(h[two] * _ODD[0] + h[two + 1] * _ODD[1]) >> shift).astype(np.int32) + slots, w.doc[two]))
    raw = w.buf.tobytes()
    chars = [raw[a : b - 1].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(w.doc_start.tolist(), w.doc_end.tolist(), strict=True)]
    c = np.frombuffer(b"".join(chars), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(w.n), [len(x) // 4 for x in chars])
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    three = mix(c[at] | c[at + 1] << np.uint64(21) | c[at + 2] << np.uint64(42))
    kinds.append(((three >> shift).astype(np.int32) + 2 * slots, doc[at]))
    return kinds


@dataclass
class NgramModel:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    bits: int = HASH_BITS

    def logits(self, w: Words, h: np.ndarray) -> np.ndarray:
        out = np.full(w.n, self.bias)
        for slot, doc in features(w, h, self.bits):
            n = np.bincount(doc, minlength=w.n)
            out += np.bincount(doc, weights=self.weights[slot], minlength=w.n) / np.maximum(n, 1)
        return out

    def probability(self, w: Words, h: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(w, h) + self.shift, -30, 30)))


def fit(texts: list[bytes], y: np.ndarray, bits: int = HASH_BITS, epochs: int = EPOCHS, l2: float = 1e-6) -> NgramModel:
    """AdaGrad on the whole sample at once; the last fifth of it calibrates."""
    y = np.asarray(y, float)
    if len(np.unique(y)) < 2 or len(y) < 10:
        return NgramModel(np.zeros(3 << bits, np.float32), 30.0 if not len(y) or y.mean() >= 0.5 else -30.0, bits=bits)
    slots, docs, values, at = [], [], [], 0
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        w = Words(part)
        for slot, doc in features(w, w.hashes(), bits):
            n = np.bincount(doc, minlength=w.n)
            code, count = np.unique(doc.astype(np.int64) << 32 | slot, return_counts=True)
            d = code >> 32
            slots.append((code & 0xFFFFFFFF).astype(np.int32)), docs.append((d + at).astype(np.int32)), values.append((count / n[d]).astype(np.float32))
        at += len(part)
    cut = len(y) - max(len(y) // 5, 2)
    slot, doc, value = np.concatenate(slots), np.concatenate(docs), np.concatenate(values)
    seen = doc < cut
    s, d, v = slot[seen], doc[seen], value[seen]
    weights, bias = np.zeros(3 << bits), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rate, g2, gb2 = 2.0, np.full(3 << bits, 1e-12), 1e-12
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(d, weights=weights[s] * v, minlength=cut), -30, 30)))
        err = (p - y[:cut]) / cut
        g = np.bincount(s, weights=err[d] * v, minlength=3 << bits) + l2 * weights
        g2 += g * g
        gb2 += err.sum() ** 2
        weights -= rate * g / np.sqrt(g2)
        bias -= 0.1 * err.sum() / np.sqrt(gb2)
    z = bias + np.bincount(doc, weights=weights[slot] * value, minlength=len(y))[cut:]
    scale, shift, t = 1.0, 0.0, y[cut:]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        scale -= 0.1 * (((p - t) * z).mean() + 1e-2 * (scale - 1))
        shift -= 0.3 * (p - t).mean()
    return NgramModel(weights.astype(np.float32), bias, float(max(scale, 1e-3)), float(shift), bits)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> NgramModel:
    got = sorted(labelled_sample(docs, labels, "quality", rows, most_bytes=most_bytes).collect(), key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["text"]))
    return fit([r["text"].encode() for r in got], np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: NgramModel, keep: float = KEEP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 << HASH_BITS floats, whatever the corpus
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            w = Words(texts)
            h = w.hashes()
            m = measures(texts, w, h)
            failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            p = shared.value.probability(w, h)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)], names=["doc_id", *names, "base_failed", "kept", "probability"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, probability double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
