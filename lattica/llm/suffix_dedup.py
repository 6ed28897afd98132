"""Suffix-array removal of byte strings that occur more than once in a corpus.

Every start of a `LENGTH`-byte string is sent where all equal strings meet, without sending a suffix for each:

1. A string's anchor is its `GRAM`-byte substring of least hash. Consecutive starts with one anchor are a piece, a
   stretch of `LENGTH` - 1 bytes more than it has starts; equal strings lie in pieces with equal anchors. Only
   (anchor hash, content hash, row, place) of each piece is written, and anchors that occur once are dropped.
2. Equal pieces are pre-aggregated: where there are several, each of their starts is repeated. Anchors of several
   different pieces need the suffix order, for which one copy of each piece's bytes is fetched.
3. The pieces of an anchor that may share a string, by the bytes around it, form a text. Its suffix array (`gsaca`) puts
   equal strings side by side; a start is repeated if a neighbour shares its first `LENGTH` bytes, which are compared
   byte by byte.
4. Anchors whose pieces exceed `TEXT_BYTES` are split before step 3: by where the anchor stands in the string, in
   `WAYS`, each part keyed by the longer bytes that all its strings share. What differs there parts; what is equal
   collapses. After four rounds a part is one string and holds nothing but copies, so no frequent passage gathers
   in one task, and nothing is capped.

Removed are the bytes covered by a repeated string. Equality is by bytes within step 3 and by 128 bits of hash in step 2.

Rows: a null text is empty. Texts shorter than `LENGTH` lose nothing. Repeated rows are copies of each other like any
other equal texts. Null and repeated ids are served by numbered rows (`common.keyed`).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import boxed, drop, free_shuffles, give_back, keyed, mix, save, slices, unboxed
from lattica.llm.gsaca import suffix_arrays

LENGTH, GRAM, TEXT_BYTES, WAYS = 200, 32, 1 << 15, 4
BATCH_BYTES, HELD_BYTES = 1 << 20, 8 << 20
PLACE_BITS, SEGMENT = 24, 8 << 20

_BYTE = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash64(content: bytes | memoryview) -> int:
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


def cut_points(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The pieces of the texts: (text number, start, starts, back, anchor hash, content hash).

    back: from the first start to the anchor; `gram` is a power of two."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(size) - size
    data = b"".join(texts)
    buf = np.frombuffer(data, np.uint8)
    assert len(buf) >> PLACE_BITS == 0
    room = np.maximum(size - length + 1, 0)
    starts = int(room.sum())
    if not starts:
        return (np.zeros(0, np.int64),) * 6
    h, step = _BYTE[buf], 1
    while step < gram:
        h = h[:-step] * (mix(np.uint64([gram + step]))[0] | np.uint64(1)) + h[step:]
        step *= 2
    h = mix(h)
    low = np.uint64((1 << PLACE_BITS) - 1)  # ties of the other bits go to the first place, in every block alike
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    text = np.repeat(np.arange(len(texts)), room)
    at = np.arange(starts) - np.repeat(np.cumsum(room) - room, room) + base[text]
    anchor = (least[at] & low).astype(np.int64)
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, starts))
    begin, text, anchor = at[first], text[first], anchor[first]
    view = memoryview(data)
    content = np.fromiter((_hash64(view[a:b]) for a, b in zip(begin.tolist(), (begin + run + length - 1).tolist(), strict=True)), np.int64, len(first))
    return text, begin - base[text], run, anchor - begin, h[anchor].view(np.int64), content


def pieces(rows: DataFrame) -> DataFrame:
    """(key, content, rid, start, starts, back) of every piece. rows: (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            # of a very long text, segments that together have each of its starts once
            cuts = [(i, at) for i, t in enumerate(texts) for at in range(0, max(len(t), 1), SEGMENT)]
            of, offset = np.array(cuts, np.int64).T
            rids = part.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)[of]
            for one in [slice(None)] if len(cuts) == len(texts) else [slice(k, k + 1) for k in range(len(cuts))]:
                text, start, starts, back, key, content = cut_points([texts[i][at : at + SEGMENT + LENGTH - 1] for i, at in cuts[one]])
                cols = [key, content, rids[one][text], start + offset[one][text], starts.astype(np.int32), back.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "content", "rid", "start", "starts", "back"])

    return rows.select("rid", "text").mapInArrow(run, "key long, content long, rid long, start long, starts int, back int")


def _fetch(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, content, n, back, bytes): the bytes of one copy of each piece."""
    per = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "content", "n", "start", "starts", "back")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            out = [(p["key"], p["content"], p["n"], p["back"], t[p["start"] : p["start"] + p["starts"] + LENGTH - 1]) for t, of in zip(texts, part.column("of").to_pylist(), strict=True) for p in of]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "content", "n", "back", "bytes"])

    return rows.select("rid", "text").join(per, "rid").mapInArrow(run, "key long, content long, n long, back int, bytes binary")


def _split(hot: DataFrame, width: int) -> DataFrame:
    """(key, content, parent_key, parent_content, back, bytes): pieces cut by where the anchor stands in the string.

    Parts are `width` places wide; a part's key is a hash of the bytes that all of its strings have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, content, back, data in zip(*(b.column(n).to_pylist() for n in ("key", "content", "back", "bytes")), strict=True):
                least = back - (len(data) - LENGTH)
                for part in range(least // width, back // width + 1):
                    lo, hi = part * width, part * width + width - 1
                    a, z = min(back, hi), max(least, lo)  # the starts here: anchor less a .. anchor less z
                    own = data[back - a : back - z + LENGTH]
                    shared = data[back - lo : back - hi + LENGTH]
                    out.append((_hash64(b"%d %d %d " % (key, width, part) + shared), _hash64(own), key, content, a, own))
            if out:
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "content", "parent_key", "parent_content", "back", "bytes"])

    return hot.select("key", "content", "back", "bytes").mapInArrow(run, "key long, content long, parent_key long, parent_content long, back int, bytes binary")


def repeated_starts(contents: list[list[bytes]], copies: list[list[int]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """For each text's pieces: the marks of their starts whose strings occur elsewhere in the text or in a copy."""
    parts, sizes, rest = [], [], []
    for pieces in contents:
        for p in pieces:
            parts += [np.frombuffer(p, np.uint8).astype(np.int16) + 2, np.ones(1, np.int16)]
            rest += [np.arange(len(p), -1, -1)]
        parts.append(np.zeros(1, np.int16))
        rest.append(np.zeros(1, np.int64))
        sizes.append(sum(map(len, pieces)) + len(pieces) + 1)
    text, size, left = np.concatenate(parts), np.array(sizes, np.int64), np.concatenate(rest)
    sa = suffix_arrays(text.astype(np.int64), size)
    lane = np.repeat(np.arange(len(size)), size)
    a, b = sa[:-1], sa[1:]
    pair = np.flatnonzero((lane[1:] == lane[:-1]) & (left[a] >= length) & (left[b] >= length))
    a, b = a[pair], b[pair]
    for k in range(length - 1, -1, -1):
        same = text[a + k] == text[b + k]
        if not same.all():
            a, b = a[same], b[same]
        if not len(a):
            break
    mark = np.zeros(len(text), bool)
    mark[a] = mark[b] = True
    out, at = [], 0
    for pieces, n in zip(contents, copies, strict=True):
        own = []
        for p, c in zip(pieces, n, strict=True):
            m = mark[at : at + max(len(p) - length + 1, 0)]
            own.append(np.ones_like(m) if c > 1 else m)
            at += len(p) + 1
        at += 1
        out.append(own)
    return out


def _ranges(marks: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(marks.view(np.int8), prepend=0, append=0)).reshape(-1, 2)


_STEP = -(-(LENGTH - GRAM) // WAYS)
#: Ranges of the distance from a string's start to its anchor, inclusive; together all distances.
RANGES = [(lo, min(lo + _STEP, LENGTH - GRAM)) for lo in range(0, LENGTH - GRAM, _STEP)]


def rivals(pieces: list[tuple]) -> list[tuple]:
    """The pieces of an anchor that may have a string in common with another one: for some range of distances, the bytes
    around the anchor that all strings there hold are also in another piece. The rest needn't be sorted."""
    seen: Counter[tuple[int, bytes]] = Counter()
    own = []
    for _, _, _, back, data in pieces:
        least = back - (len(data) - LENGTH)
        own.append([(lo, data[back - lo : back - hi + LENGTH]) for lo, hi in RANGES if lo <= back and least <= hi])
        seen.update(own[-1])
    return [p for p, windows in zip(pieces, own, strict=True) if any(seen[w] > 1 for w in windows)]


def _order(pieces: DataFrame) -> DataFrame:
    """(key, content, back_from, back_to): repeated starts, by their distance before the anchor (inclusive).

    pieces: (key, content, n, back, bytes), the pieces of a key at most TEXT_BYTES together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[list[tuple]] = []
        size = 0

        def close() -> pa.RecordBatch:
            out = []
            texts[:] = [t for t in map(rivals, texts) if t]
            texts.sort(key=lambda t: sum(len(p[4]) for p in t))
            at = 0
            while at < len(texts):
                end, total, first = at, 0, sum(len(p[4]) for p in texts[at])
                while end < len(texts) and (end == at or total < BATCH_BYTES and sum(len(p[4]) for p in texts[end]) <= 2 * first):
                    total += sum(len(p[4]) for p in texts[end])
                    end += 1
                group = texts[at:end]
                for t, marks in zip(group, repeated_starts([[p[4] for p in t] for t in group], [[p[2] for p in t] for t in group]), strict=True):
                    out += [(p[0], p[1], int(p[3] - z + 1), int(p[3] - a)) for p, m in zip(t, marks, strict=True) for a, z in _ranges(m)]
                at = end
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "content", "back_from", "back_to"])

        for b in batches:
            for p in zip(*(b.column(n).to_pylist() for n in ("key", "content", "n", "back", "bytes")), strict=True):
                if not texts or texts[-1][-1][0] != p[0]:
                    if size >= HELD_BYTES:
                        yield close()
                        texts, size = [], 0
                    texts.append([])
                texts[-1].append(p)
                size += len(p[4])
        if texts:
            yield close()
            texts.clear()
        give_back()

    return pieces.select("key", "content", "n", "back", "bytes").repartition("key").sortWithinPartitions("key", "content").mapInArrow(run, "key long, content long, back_from long, back_to long")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(rid, of array<struct<start,end>>): per row, the byte ranges (not merged) that repeated strings cover."""
    spark = rows.sparkSession
    made: list[DataFrame] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(save(df, label))
        return made[-1]

    every = save(pieces(rows), "suffix-pieces")
    often = save(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "suffix-keys")
    held = keep(every.join(often, "key"), "suffix-held")
    drop(every), drop(often), free_shuffles(spark)
    unlike = keep(held.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start", "starts", "back")).alias("one")).select("key", "content", "n", "one.*"), "suffix-unlike")
    level = keep(unlike.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("starts") + LENGTH - 1).alias("size")).filter("kinds > 1"), "suffix-level")
    found = [unlike.filter("n > 1").select("key", "content", (F.col("back") - F.col("starts") + 1).cast("long").alias("back_from"), F.col("back").cast("long").alias("back_to"))]
    contents = keep(_fetch(unlike.join(level.select("key"), "key"), rows), "suffix-contents")
    free_shuffles(spark)
    found.append(keep(_order(contents.join(level.filter(F.col("size") <= TEXT_BYTES).select("key"), "key")), "suffix-found"))
    hot = contents.join(level.filter(F.col("size") > TEXT_BYTES).select("key"), "key")
    width, parents = LENGTH - GRAM + 1, []
    while hot.limit(1).count():
        width = -(-width // WAYS)
        part = keep(_split(hot, width), "suffix-split")
        parents.append(part.select("key", "content", "parent_key", "parent_content", F.col("back").cast("long").alias("b"), (F.col("back") - F.octet_length("bytes") + LENGTH).cast("long").alias("a")))
        unlike_part = keep(part.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("back", "bytes")).alias("one")).select("key", "content", "n", "one.*"), "suffix-split-unlike")
        level = keep(unlike_part.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("bytes")).alias("size")).filter("kinds > 1"), "suffix-split-level")
        small = F.lit(True) if width == 1 else F.col("size") <= TEXT_BYTES
        here = unlike_part.filter("n > 1").select("key", "content", (F.col("back") - F.octet_length("bytes") + LENGTH).cast("long").alias("back_from"), F.col("back").cast("long").alias("back_to"))
        here = here.union(keep(_order(unlike_part.join(level.filter(small).select("key"), "key")), "suffix-split-found"))
        for up in reversed(parents):  # to the pieces that were split
            here = here.join(up, ["key", "content"]).select(F.col("parent_key").alias("key"), F.col("parent_content").alias("content"), F.greatest("back_from", "a").alias("back_from"), F.least("back_to", "b").alias("back_to")).distinct()
        found.append(keep(here, "suffix-split-up"))
        if width == 1:
            break
        hot = unlike_part.join(level.filter(F.col("size") > TEXT_BYTES).select("key"), "key")
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.union(f)
    placed = held.join(keep(ranges, "suffix-ranges"), ["key", "content"])
    first = F.col("start") + F.col("back")  # where the anchor is
    placed = placed.select("rid", (first - F.col("back_to")).alias("start"), (first - F.col("back_from") + LENGTH).alias("end"))
    out = keep(placed.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("of")), "suffix-rows")
    for df in made:
        if df is not out:
            drop(df)
    free_shuffles(spark)
    return out


def merge(of: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in of or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edge = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans themselves."""
    rows = keyed(docs, label="suffix-keyed")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            out = []
            for t, of in zip(texts, part.column("of").to_pylist(), strict=True):
                spans = merge(of)
                out.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(t, spans)).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", *names])

    found = repeated_ranges(rows)
    return rows.join(found, "rid", "left").select("doc_id", "text", "of").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their edges, so that what is left is text."""
    out = []
    for a, b in spans:
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def cut(docs: DataFrame) -> DataFrame:
    """The documents with their own columns, texts without their repeated strings (by whole characters)."""
    rows = keyed(boxed(docs), columns=("text", "row"), label="suffix-keyed")
    found = repeated_ranges(rows)
    row = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            new = part.column("text").to_pylist()
            chars: list[int | None] = [None] * len(new)
            for i, of in enumerate(part.column("of").to_pylist()):
                if spans := characters(texts[i], merge(of)):
                    new[i] = without(texts[i], spans).decode()
                    chars[i] = len(new[i])
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(new, pa.string()), pa.array(chars, pa.int64())], names=["row", "text", "chars"])

    return unboxed(rows.join(found, "rid", "left").select("row", "text", "of").mapInArrow(run, f"row {row}, text string, chars long"), docs)
