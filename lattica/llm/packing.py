"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

An instance is its histogram of piece lengths: at most `CAPACITY` counts, whatever the corpus. On the driver, the
reduction fixes sets of one, two or three items that dominate every alternative for an item, again and again while the
instance shrinks; best-fit decreasing packs the rest. Both work on counts: a pattern of lengths is used so many times.
The plan has at most a few patterns a length, however many pieces there are, and is the only thing sent to the tasks. Each piece finds its pattern and its place by its rank among pieces of its
length, which is a count within its partition plus the counts of the partitions before.

Rows: null or empty text is a document of the end id alone. Repeated documents are packed each. The piece table is
written once, so ranks don't move when a task runs again.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import save, texts_of

CAPACITY, END_ID, CACHE_PIECES = 2048, 0, 500_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters only: for them the pattern below splits as the tokenizer's own does.
_PLAIN = re.compile(f"[\\x00-\\x1b\\x20-\\x7f{_LETTERS}]*")
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")


class Encoder(dict):
    """Piece of text to its ids as little-endian 32-bit bytes; ids are those of the byte-level vocabulary file.

    Most pieces of a corpus are repeats, so ids are kept by piece, in at most `CACHE_PIECES` entries."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = np.array(self.pieces._encode_single_piece(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, _SPLIT.findall(text)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    if not _encoder:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoder.append(Encoder())
    return _encoder[0]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth (of its length in its partition), and ids if asked for."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u4").tobytes()
        seen: Counter[int] = Counter()
        part, enc = TaskContext.get().partitionId(), encoder()
        for batch in batches:
            doc, rows, ids = [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                all_ids = enc.ids(text.decode()) + end
                n = len(all_ids) // 4
                first = n - (n - 1) // capacity * capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    own = all_ids[4 * start : 4 * (start + (capacity if k else first))]
                    doc.append(i)
                    rows.append((k, start, len(own) // 4, zlib.crc32(own), part, seen[len(own) // 4]))
                    seen[len(own) // 4] += 1
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            cols = [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))] if rows else None
            if cols:
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


Pattern = tuple[tuple[int, ...], int]


def _beside(left: Counter[int], big: int, capacity: int) -> tuple[int, ...] | None:
    """What dominates every other choice beside an item of length `big`: none, one or two lengths; None: no rule holds.

    Let k items at most fit beside it. Nothing fits: it stands alone. One fits, or the largest that fits fills the rest:
    that one. Two fit: the largest alone, if it is no less than the best pair; or the best pair (a, b), if a is the
    largest that fits and every pair that fits has a member of at most b."""
    room = capacity - big
    others = sorted(k for k in left if k <= room and left[k] > (k == big))
    if not others:
        return ()
    number = lambda k: left[k] - (k == big)
    least = [k for k in others[:3] for _ in range(min(number(k), 3))][:3]
    best = others[-1]
    if best == room or sum(least[:2]) > room or len(least) < 2:
        return (best,)
    if len(least) > 2 and sum(least) <= room:
        return None
    pair = (0, 0)
    low = 0
    for high in reversed(others):  # the largest partner of each grows as it shrinks
        while low < len(others) and others[low] + high <= room:
            low += 1
        k = min(low - 1, others.index(high) - (number(high) < 2)) if low else -1
        if k >= 0 and others[k] + high > sum(pair):
            pair = (high, others[k])
    if best >= sum(pair):
        return (best,)
    a, b = pair
    if a != best:
        return None
    between = [k for k in others if k > b for _ in range(min(number(k) - (k == a), 2))][:2]
    return pair if len(between) < 2 or sum(between) > room else None


def reduce(count: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that are part of some optimal packing, and the counts that remain.

    What dominates for one item does so for all of its length while its partners last, so a pattern is fixed as often as
    they do. Each pattern uses up a length, but for an odd rest of one; there are at most two a length."""
    left = Counter({k: n for k, n in count.items() if n})
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for big in sorted(left, reverse=True):
            while left.get(big) and (beside := _beside(left, big, capacity)) is not None:
                lengths = (big, *beside)
                times = min(left[x] // n for x, n in Counter(lengths).items())
                fixed.append((lengths, times))
                for x in lengths:
                    left[x] -= times
                    if not left[x]:
                        del left[x]
                changed = True
    return fixed, dict(left)


def best_fit(count: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing on counts: bins alike in content are one entry with a number."""
    room: dict[int, list[list]] = {}
    sizes: list[int] = []
    done: list[Pattern] = []

    def put(free: int, lengths: tuple[int, ...], times: int) -> None:
        if not free:
            done.append((lengths, times))
            return
        if free not in room:
            room[free] = []
            insort(sizes, free)
        room[free].append([lengths, times])

    for x in sorted(count, reverse=True):
        n = count[x]
        while n:
            at = bisect_left(sizes, x)
            if at == len(sizes):
                each = capacity // x
                if n >= each:
                    put(capacity - each * x, (x,) * each, n // each)
                if n % each:
                    put(capacity - n % each * x, (x,) * (n % each), 1)
                break
            free = sizes[at]
            entry = room[free][-1]
            each = min(free // x, n)
            times = min(entry[1], n // each)
            put(free - each * x, entry[0] + (x,) * each, times)
            n -= each * times
            entry[1] -= times
            if not entry[1]:
                room[free].pop()
                if not room[free]:
                    del room[free]
                    sizes.remove(free)
    return done + [(lengths, times) for entries in room.values() for lengths, times in entries]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce(count, capacity)
    return fixed + best_fit(rest, capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    parts = save(pieces(docs, capacity, with_ids), "packing-pieces")
    held = parts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    count = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    start: Counter[int] = Counter()
    code, first, base, place, at = [], [], [], [], 0
    for lengths, times in plan(count, capacity):
        offset = 0
        for x in lengths:
            code.append(x << 44 | start[x])
            first.append(start[x]), base.append(at), place.append(offset)
            start[x] += times
            offset += x
        at += times
    order = np.argsort(np.array(code, np.int64))
    table = spark.sparkContext.broadcast(tuple(np.array(a, np.int64)[order] for a in (code, first, base, place)))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "before")
    ranked = parts.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*keep, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, base, place = table.value
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            k = np.searchsorted(code, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(base[k] + rank - first[k]), pa.array(place[k])], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def report(docs: DataFrame) -> DataFrame:
    return pack(docs)
