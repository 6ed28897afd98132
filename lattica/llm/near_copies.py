"""SimHash near-duplicates made whole: texts whose sets of five-word shingles have a Jaccard similarity of at least 4/5.

The SimHash operator groups texts first: fingerprints of their single words, repeats included, linked at few differing
bits by its index over byte positions, each link checked on the sets of shingles. Fingerprints of the shingles themselves
would not do: a changed word changes five of them, and hardly a pair at 0.8 stays within the radius (see the README).

A second search takes these groups as they are and looks only for links between different ones, which the radius misses.
It is whole: with any fixed order of shingles, two such sets share one of each other's first n - ceil(4n/5) + 1
(prefix filter), so lists keyed by these shingles hold every pair. The order puts shingles that a sample of the texts
holds often last, which keeps lists short; it decides the cost and never the result. Pairs of a list are left out only
where a group holds both, or where sizes, or the bits in which their parity bitmaps differ, already exclude the
similarity: bitmaps of `BITMAP` bits within the lists, then bitmaps of at least two bits a shingle, which hardly a pair
below 0.75 passes. The rest are checked on the sets themselves, so sets travel for few pairs but links. In a list of more
than `LONG` texts each is first compared with one of them, and afterwards only with those that no link yet leads to, so
that a large group of near copies doesn't yield all its pairs.

Shingles count as equal by a 64-bit hash. Texts of the same words (128 bits of hash, case of ASCII letters ignored) are
copies, empty ones too; fewer than five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, boxed, drop, free_shuffles, give_back, keyed, mix, save, slices, unboxed
from lattica.llm.simhash import components, links, majority

WIDTH, LONG, BITMAP = 5, 2, 512
#: The order's hint: one text in SAMPLE is read, and at most COMMON shingles go to the tasks.
SAMPLE, COMMON = 16, 1 << 18


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's words in their order, text after text."""
    w = Words([t.lower() for t in texts])
    return w.hashes(), w.count


def shingle_sets(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's different shingles, ascending, text after text. h, n: its words (`word_hashes`)."""
    k = np.maximum(n - WIDTH + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), k)
    if not len(doc):
        return np.zeros(0, np.uint64), k
    place = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    at = place + (np.cumsum(n) - n)[doc]
    out = np.zeros(len(doc), np.uint64)
    for j in range(WIDTH):
        out = mix(out + np.where(place + j < n[doc], h[np.minimum(at + j, len(h) - 1)], np.uint64(0)) + np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.bincount(doc[new], minlength=len(n))


def bitmaps(h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each text's parity bitmap: bit k tells whether an odd number of its shingles have h mod width = k. The width is a
    power of two, at least twice the number of shingles; folding one in halves by XOR gives that of half its width."""
    width = np.maximum(BITMAP, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(width)])
    doc = np.repeat(np.arange(len(size)), size)
    bits = np.bincount(first[doc] + (h & (width[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(first[-1])) & 1
    packed = np.packbits(bits.astype(np.uint8)).tobytes()
    return [packed[a:b] for a, b in zip((first[:-1] // 8).tolist(), (first[1:] // 8).tolist(), strict=True)]


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap folded to `size` bytes, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size // 8), 0)


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sampled texts hold three times or more, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(*word_hashes(texts))[0].view(np.int64))], names=["h"])

    some = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0).select("text")
    top = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def signatures(rows: DataFrame) -> DataFrame:
    """rid, words (hash of the word sequence), size, prefix, bitmap (of BITMAP bits), wide (of two bits a shingle), fp (SimHash of the words)."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for part, texts in slices(batches):
            each, count = word_hashes(texts)
            h, size = shingle_sets(each, count)
            doc = np.repeat(np.arange(len(texts)), size)
            wide = bitmaps(h, size)
            rank = np.zeros(len(h), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                rank = np.where(common[at] == h, often[at], 0)
            order = np.lexsort((h, rank, doc))
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            length = np.where(size > 0, size - (4 * size + 4) // 5 + 1, 0)
            prefix = h[order][place < length[doc]]
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            words = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
            cols = [part.column("rid"), pa.array(words, pa.binary()), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.view(np.int64))), pa.array([folded(b, BITMAP // 8).tobytes() for b in wide], pa.binary()), pa.array(wide, pa.binary()), pa.array(majority(each, count).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "words", "size", "prefix", "bitmap", "wide", "fp"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, words binary, size int, prefix array<long>, bitmap binary, wide binary, fp long")


def _words(column: pa.Array) -> np.ndarray:
    """Binaries of one length as rows of 64-bit words."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint64).reshape(len(column), -1)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """The columns of whole lists, batch by batch, and where lists begin and end. Rows come ordered by the first column,
    the key; what is held is a batch and the longest list."""
    held: list[list[np.ndarray]] = []

    def close() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        edge = np.flatnonzero(np.diff(cols[0])) + 1
        return cols, np.concatenate([[0], edge]), np.concatenate([edge, [len(cols[0])]])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_words(c) for c in batch.columns]
        unlike = np.flatnonzero(cols[0] != cols[0][-1])
        last = int(unlike[-1]) + 1 if len(unlike) else 0  # the last list may go on in the next batch
        if last or (held and held[-1][0][-1] != cols[0][0]):
            if last:
                held.append([c[:last] for c in cols])
            yield close()
        held.append([c[last:].copy() for c in cols])
    if held:
        yield close()
    give_back()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, rid) of the lists with two texts or more."""
    for (h, rid), begin, end in _lists(batches):
        keep = np.repeat(end - begin > 1, end - begin)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(rid[keep])], names=["h", "rid"])


def _possible(a: int | np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False where sizes a, b or bitmaps x, y exclude the similarity: 5 * least >= 4 * most, 9 * differing <= a + b."""
    ok = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
    return ok & (9 * np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= a + b)


def _different(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.concatenate(found, 1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _pairs(lists: DataFrame, long: int, second: bool) -> DataFrame:
    """Different (a, b), a < b, of different roots, that may be similar. lists: h, rid, size, root, bitmap. second: all
    such pairs of long lists; else all of short lists, and in long ones each text with one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h, rid, size, root, bitmap), first, last in _lists(batches):
            size = size.astype(np.int64)
            found = [np.zeros((2, 0), np.int64)]
            for begin, end in zip(first.tolist(), last.tolist(), strict=True):
                r, s, c, m = rid[begin:end], size[begin:end], root[begin:end], bitmap[begin:end]
                if (second and end - begin <= long) or (c == c[0]).all():
                    continue
                # the one that all are compared with is the same in a group's many lists, so that these give few different pairs
                pivots = range(len(r)) if second or len(r) <= long else [int(np.argmin(r))]
                for i in pivots:
                    rest = slice(i + 1, None) if len(pivots) > 1 else slice(None)
                    ok = _possible(s[i], s[rest], m[i], m[rest]) & (c[rest] != c[i])
                    other = r[rest][ok]
                    if len(other):
                        found.append(np.stack([np.minimum(other, r[i]), np.maximum(other, r[i])]))
                    if len(found) > 10_000:
                        yield _different(found)
                        found = found[:1]
            yield _different(found)

    return lists.select("h", "rid", "size", "root", "bitmap").repartition("h").sortWithinPartitions("h").mapInArrow(run, "a long, b long").distinct()


def _near_fingerprints(ones: DataFrame) -> DataFrame:
    """(a, b), a < b: texts of equal fingerprints, each with the least of them, and these for linked fingerprints."""
    least = save(ones.groupBy("fp").agg(F.min("rid").alias("one")), "near-fp")
    equal = ones.join(least, "fp").filter("rid > one").select(F.col("one").alias("a"), F.col("rid").alias("b"))
    end = lambda k, v: least.select(F.col("fp").alias(k), F.col("one").alias(v))
    near = links(least.select("fp")).join(end("src", "x"), "src").join(end("dst", "y"), "dst")
    return equal.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _verified(pairs: DataFrame, rows: DataFrame, signed: DataFrame) -> DataFrame:
    """(src, dst): the pairs whose sets are similar, of those that their wide bitmaps let pass."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = (batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()).tolist()
            ok = []
            for x, y, n in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), size, strict=True):
                k = min(len(x), len(y))
                ok.append(9 * int(np.bitwise_count(folded(x, k) ^ folded(y, k)).sum(dtype=np.int64)) <= n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            h, size = shingle_sets(*word_hashes(texts))
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([x.tobytes() for x in np.split(h, np.cumsum(size)[:-1])], pa.binary())], names=["rid", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    spark = rows.sparkSession
    wide = lambda k, v, n: signed.select(F.col("rid").alias(k), F.col("wide").alias(v), F.col("size").alias(n))
    sized = pairs.join(wide("a", "x", "m"), "a").join(wide("b", "y", "n"), "b").filter(5 * F.least("m", "n") >= 4 * F.greatest("m", "n"))
    left = save(sized.select("a", "b", "x", "y", "m", "n").mapInArrow(sift, "a long, b long"), "near-left")
    drop(pairs)
    free_shuffles(spark)
    pairs = left
    ids = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    held = save(rows.select("rid", "text").join(ids, "rid", "left_semi").mapInArrow(sets, "rid long, shingles binary"), "near-sets")
    free_shuffles(spark)
    side = lambda k, v: held.select(F.col("rid").alias(k), F.col("shingles").alias(v))
    links = save(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "src long, dst long"), "near-links")
    drop(held)
    drop(pairs)
    free_shuffles(spark)
    return links


def _placed(texts: DataFrame, root: DataFrame) -> DataFrame:
    """With the column root: the group that the links known so far lead to."""
    return texts.join(root.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def groups(rows: DataFrame, long: int = LONG) -> DataFrame:
    """(rid, root): root is the least rid reachable over copies and links. rows: rid (unique), text."""
    spark = rows.sparkSession
    signed = save(signatures(rows), "near-signatures")
    copies = save(signed.select("rid", "words").join(signed.groupBy("words").agg(F.min("rid").alias("one")), "words").select("rid", "one"), "near-copies")
    ones = signed.join(copies.filter("rid = one").select("rid"), "rid", "left_semi")
    short = save(ones.select(F.explode("prefix").alias("h"), "rid").repartition("h").sortWithinPartitions("h").mapInArrow(_shared, "h long, rid long"), "near-lists")
    free_shuffles(spark)
    similar = save(_near_fingerprints(ones.select("rid", "fp")), "near-simhash")
    maps = save(signed.select("rid", "size", "bitmap", "wide"), "near-bitmaps")
    drop(signed)
    root = components(_verified(similar, rows, maps), "near-cc")
    lists = save(short.join(_placed(maps.select("rid", "size", "bitmap"), root), "rid"), "near-members")
    drop(short)
    free_shuffles(spark)
    # what follows leaves out the pairs that a group holds, so each round goes on from the groups of the one before
    more = lambda found: components(root.toDF("src", "dst").union(_verified(save(found, "near-pairs"), rows, maps)), "near-cc")
    root = more(_pairs(lists, long, False))
    if lists.groupBy("h").count().filter(F.col("count") > long).limit(1).count():
        root = more(_pairs(_placed(lists.drop("root"), root), long, True))
    drop(lists)
    drop(maps)
    free_shuffles(spark)
    return copies.join(root.withColumnRenamed("node", "one"), "one", "left").select("rid", F.coalesce("root", "one").alias("root"))


def representatives(docs: DataFrame, long: int = LONG) -> DataFrame:
    """The documents' own columns: of each group, the row with the smallest id, nulls last (of repeated rows, one)."""
    rows = keyed(boxed(docs), columns=("text", "row"), label="near-keyed")
    first = rows.select("rid", "doc_id").join(groups(rows, long), "rid").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("one"))
    return unboxed(rows.join(first.select(F.col("one.rid").alias("rid")), "rid", "left_semi"), docs)
