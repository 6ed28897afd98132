"""Benchmark decontamination with one FM-index per training shard.

A shard is a stretch of one partition's documents. Its text is the sequence of word ids, words of no benchmark item
being breaks; runs shorter than the shortest window cannot hold a match and are left out before indexing. The index is
the Burrows-Wheeler transform of that sequence under a wavelet matrix, with every `SAMPLE`-th suffix position and each
run's first one kept. All benchmark windows are searched backward at once, occurrences are located by walking to a
kept position, and word spans are merged per document. Documents are never shuffled and matches never cross them.

The benchmark is read in blocks of at most `BENCH_BYTES` of text, so what a task receives is bounded; with more than
one block, the documents are searched once per block and the spans merged per row.

Rows: null or empty text has no words. Benchmark rows without an id or without a word match nothing; rows that share
an item_id are one item. Repeated documents each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import boxed, keyed, save, texts_of, unboxed

WINDOW, MIN_ITEMS, SAMPLE = 8, 2, 8
SHARD_BYTES, BENCH_BYTES = 24_000_000, 8_000_000

_BREAKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_BREAKS).split()


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, many at once."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(int(symbols - 1).bit_length(), 1) - 1, -1, -1):
            one = (seq >> bit & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32)
            zeros = len(seq) - int(ones[-1])
            self.levels.append((bit, ones, zeros))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(end), end
        for bit, ones, zeros in self.levels:
            up = (symbol >> bit & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return high - low


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that still share a rank are sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.concatenate([[True], seq[order[1:]] != seq[order[:-1]]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, -1
    k = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        pos = order[at]
        key = rank[pos] * (n + 2) + rank[np.minimum(pos + k, n)] + 1
        by = np.argsort(key, kind="stable")
        order[at] = pos[by]
        key = key[by]
        split = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] |= split
        group = np.maximum.accumulate(np.where(split, at, 0))
        rank[order[at]] = group
        k *= 2


class FmIndex:
    """Over runs of symbols 1..symbols; matches stay inside a run."""

    def __init__(self, runs: np.ndarray, symbols: int, sample: int = SAMPLE):
        """runs: the symbols, each run followed by one 0."""
        stop = runs == 0
        breaks = int(stop.sum())
        unlike = np.where(stop, np.cumsum(stop) - 1, runs.astype(np.int64) + breaks)
        sa = suffix_array(unlike)
        self.n = len(runs)
        self.bwt = runs[sa - 1]
        self.first = np.searchsorted(unlike[sa], np.arange(symbols + 2) + breaks)  # C: the first row of each symbol
        self.first[0] = 0
        self.tree = WaveletMatrix(self.bwt, symbols + 1)
        starts = np.concatenate([[True], stop[:-1]])
        self.kept = (starts | (np.arange(self.n) % sample == 0))[sa]
        self.before = np.cumsum(self.kept, dtype=np.int32) - 1  # a kept row's place among the kept ones
        self.place = sa[self.kept]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (right-aligned in a matrix) by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            live = live[(length[live] >= back) & (high[live] > low[live])]
            if not len(live):
                break
            c = patterns[live, -back]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: step back through the text until a kept row."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.kept[at[live]]
            end = live[done]
            out[end] = self.place[self.before[at[end]]] + steps[end]
            live = live[~done]
            c = self.bwt[at[live]]
            at[live] = self.first[c] + self.tree.rank(c, at[live])
            steps[live] += 1
        return out


class Benchmark:
    """A block of items: vocabulary, distinct windows, and the items of each window."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if item is None or not ids:
                continue
            for i in range(max(len(ids) - window, 0) + 1):
                seen.setdefault(tuple(ids[i : i + window]), set()).add(str(item))
        self.length = np.array([len(w) for w in seen], np.int64)
        self.patterns = np.zeros((len(seen), window), np.int64)
        for k, w in enumerate(seen):
            self.patterns[k, window - len(w) :] = w
        self.items = [sorted(x) for x in seen.values()]
        self.least = int(self.length.min()) if len(seen) else 0


def shard_hits(ids: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every occurrence in a shard's word ids, where 0 is a break and the last one is 0."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not bench.least:
        return none
    edge = np.flatnonzero(np.diff((ids > 0).view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= bench.least
    start, size = start[long], (end - start)[long] + 1  # with the break after it
    if not len(start):
        return none
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    index = FmIndex(ids[at], len(bench.vocab))
    low, high = index.search(bench.patterns, bench.length)
    count = high - low
    window = np.repeat(np.arange(len(low)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return at[index.locate(rows)], window


def hit_ranges(text: bytes, hit: np.ndarray | None) -> list[dict[str, int]]:
    """Stretches of hit words: as word numbers [start, end), and as byte offsets [first, last)."""
    out: list[dict[str, int]] = []
    if hit is None:
        return out
    before = False
    for k, (m, h) in enumerate(zip(_WORD.finditer(text.lower()), hit.tolist(), strict=True)):
        if h and before:
            out[-1] |= {"end": k + 1, "last": m.end()}
        elif h:
            out.append({"start": k, "end": k + 1, "first": m.start(), "last": m.end()})
        before = h
    return out


def without(text: bytes, hits: list[dict[str, int]]) -> str:
    edge = [0, *(x for h in hits for x in (h["first"], h["last"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)).decode()


def _search(batches: Iterator[pa.RecordBatch], bench: Benchmark) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int], list[np.ndarray | None], list[set[str]]]]:
    """Shard by shard: the rows, their texts, word counts, hit words (None: none) and items."""
    held: list[tuple[pa.RecordBatch, list[bytes]]] = []
    counts: list[int] = []
    ids: list[np.ndarray] = []
    size = 0
    stop = np.zeros(1, np.int32)

    def close() -> Iterator[tuple]:
        nonlocal held, counts, ids, size
        n = np.array(counts, np.int64)
        first = np.cumsum(n + 1) - (n + 1)
        at, window = shard_hits(np.concatenate(ids), bench)
        doc = np.searchsorted(first, at, "right") - 1
        hits: list[np.ndarray | None] = [None] * len(counts)
        items: list[set[str]] = [set() for _ in counts]
        for d, p, w in zip(doc.tolist(), (at - first[doc]).tolist(), window.tolist(), strict=True):
            if hits[d] is None:
                hits[d] = np.zeros(counts[d], bool)
            hits[d][p : p + int(bench.length[w])] = True
            items[d].update(bench.items[w])
        begin = 0
        for part, texts in held:
            end = begin + len(texts)
            yield part, texts, counts[begin:end], hits[begin:end], items[begin:end]
            begin = end
        held, counts, ids, size = [], [], [], 0

    for batch in batches:
        begin, texts = 0, texts_of(batch.column("text"))
        for i, t in enumerate(texts):
            w = words(t)
            counts.append(len(w))
            ids += [np.fromiter(map(bench.vocab.get, w, repeat(0)), np.int32, len(w)), stop]
            size += len(t)
            if size >= SHARD_BYTES or i + 1 == len(texts):
                held.append((batch.slice(begin, i + 1 - begin), texts[begin : i + 1]))
                begin = i + 1
                if size >= SHARD_BYTES:
                    yield from close()
    if counts:
        yield from close()


def blocks(benchmark: DataFrame, limit: int = BENCH_BYTES) -> Iterator[Benchmark]:
    """The items in blocks of at most `limit` bytes of text (or one item); the driver holds one block at a time."""
    held: list[tuple[object, bytes]] = []
    size = 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = (r["text"] or "").encode()
        if held and size + len(text) > limit:
            yield Benchmark(held)
            held, size = [], 0
        held.append((r["item_id"], text))
        size += len(text)
    yield Benchmark(held)


_HITS = "array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>"


def hits(docs: DataFrame, bench: Benchmark, id_cols: list[str]) -> DataFrame:
    """id_cols, n_words, hits (merged, in order), items (sorted): one row per document, against one block."""
    shared = docs.sparkSession.sparkContext.broadcast(bench)  # of BENCH_BYTES of text at most
    ids = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    ranges = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "last")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, n, hit, items in _search(batches, shared.value):
            cols = [pa.array(n, pa.int64()), pa.array([hit_ranges(t, h) for t, h in zip(texts, hit, strict=True)], ranges), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in id_cols), *cols], names=[*id_cols, "n_words", "hits", "items"])

    return docs.select(*id_cols, "text").mapInArrow(run, f"{ids}, n_words long, hits {_HITS}, items array<string>")


#: SQL: the ranges that several blocks found in a text, merged where their words overlap or follow one another.
_MERGED = f"""aggregate(array_sort(hits), cast(array() as {_HITS}), (a, x) -> case when size(a) > 0 and element_at(a, -1).end >= x.start
    then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end), 'first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last))))
    else concat(a, array(x)) end)"""


def _every_block(rows: DataFrame, found: Iterator[Benchmark]) -> DataFrame:
    """rid, n_words, hits, items against all blocks; each block's findings are a written table. rows: rid, text."""
    parts = None
    for bench in found:
        part = save(hits(rows, bench, ["rid"]), "decontam-block")
        parts = part if parts is None else parts.union(part)
    whole = parts.groupBy("rid").agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items")))  # a row a block
    return whole.select("rid", "n_words", F.expr(_MERGED).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def _first_two(benchmark: DataFrame, limit: int) -> tuple[Benchmark, Iterator[Benchmark] | None]:
    """The first block; and all of them, first one included, if there are several."""
    found = blocks(benchmark, limit)
    first = next(found)
    second = next(found, None)
    return first, None if second is None else chain([first, second], found)


def search(docs: DataFrame, benchmark: DataFrame, limit: int = BENCH_BYTES) -> DataFrame:
    """doc_id, n_words, hits, items of each document against the whole benchmark."""
    first, every = _first_two(benchmark, limit)
    if every is None:
        return hits(docs.select("doc_id", "text"), first, ["doc_id"])
    rows = keyed(docs, label="decontam-keyed")
    return rows.select("rid", "doc_id").join(_every_block(rows, every), "rid").select("doc_id", "n_words", "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return search(docs, benchmark).select(
        "doc_id", "n_words", F.expr("aggregate(hits, 0L, (a, x) -> a + x.end - x.start)").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= MIN_ITEMS).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = BENCH_BYTES) -> DataFrame:
    """The documents' own columns: rows of `MIN_ITEMS` items or more are gone, and the merged passages of fewer are cut
    from the others, once, as the input has them. Rows are judged each by itself, whatever their ids; the result is the
    same for any `limit` of the benchmark's blocks."""
    first, every = _first_two(benchmark, limit)
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, _, hit, items in _search(batches, shared.value):
            keep = [len(i) < MIN_ITEMS for i in items]
            yield _cut(part, [hit_ranges(t, h) if k else [] for t, h, k in zip(texts, hit, keep, strict=True)]).filter(pa.array(keep, pa.bool_()))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield _cut(part, part.column("hits").to_pylist())

    rows = boxed(docs).select("doc_id", "text", "row")
    schema = f"text string, row {rows.schema['row'].dataType.simpleString()}, chars long"
    if every is None:
        return unboxed(rows.mapInArrow(one, schema), docs)
    rows = keyed(rows, columns=("text", "row"), label="decontam-keyed")
    ordinary = _every_block(rows, every).filter(F.size("items") < MIN_ITEMS).select("rid", "hits")
    return unboxed(rows.join(ordinary, "rid").select("text", "row", "hits").mapInArrow(several, schema), docs)


def _cut(part: pa.RecordBatch, hits: list[list[dict[str, int]]]) -> pa.RecordBatch:
    new = part.column("text").to_pylist()
    chars: list[int | None] = [None] * len(new)
    for i, h in enumerate(hits):
        if h:
            new[i] = without(new[i].encode(), h)
            chars[i] = len(new[i])
    return pa.RecordBatch.from_arrays([pa.array(new, pa.string()), part.column("row"), pa.array(chars, pa.int64())], names=["text", "row", "chars"])
