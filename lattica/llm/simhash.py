"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Candidate search is an inverted index over byte positions. Two fingerprints that differ in at most two bits agree in
at least six of their eight bytes, so they meet in at least one of the 28 lists keyed by six (position, byte) entries.
A list's key *is* the count filter: a pair shares a list exactly when its tally of equal positional bytes reaches six.
Distinct fingerprints in one list differ in two bytes only, so a list holds at most 65,536 of them whatever the
corpus; that bound is what makes it safe to handle a list in one task. Within a short list each pair's tally is counted
and the pair verified by its differing bits; in a long one, members are tied through the bits that linked members have
in common. Only a spanning forest of the links leaves the task, so a dense cluster never yields all its pairs.

Rows: null or empty text has fingerprint zero; a null doc_id is kept as a row but names no component other than by
null, unless a document with an id is reachable. Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import boxed, drop, keyed, save, shared_dir, slices, unboxed

WIDTH, BITS, SEED, CHUNK = 3, 2, 42, 1 << 16

_SETS = [tuple(p for p in range(8) if p not in gone) for gone in combinations(range(8), 2)]
#: For each list family: the bits that its six byte positions cover.
MASKS = np.array([sum(0xFF << (8 * p) for p in kept) for kept in _SETS], dtype=np.uint64)


def majority(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each text's fingerprint: the bits that are set in over half of its hashes, which follow one another text by text.

    Bits are unpacked for `CHUNK` hashes at a time, whatever a text's length."""
    doc = np.repeat(np.arange(len(size)), size)
    sums = np.zeros((len(size), 64), np.int64)
    for a in range(0, len(hashes), CHUNK):
        some = doc[a : a + CHUNK]
        first = np.flatnonzero(np.diff(some, prepend=-1))
        bits = np.unpackbits(hashes[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[some[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    words = text.lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(words) - width + 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, fp long): the fingerprint's 64 bits as a signed long, one row per document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            hashes = [shingle_hashes(t) for t in texts]
            fp = majority(np.concatenate(hashes), np.array([len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {id_type}, fp long")


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of each pair: at how many of the eight positions its bytes are equal."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Pairs whose tally reaches the least that linked pairs have, verified by their differing bits."""
    out = _shared_bytes(a, b) >= 8 - bits
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= bits
    return out


def _forest(fp: np.ndarray, run: np.ndarray, family: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many lists at once (run numbers them): for two members the verified pair; for more, each member is
    tied to the least member that shares it on all but `bits` of the two free bytes' bits. Those ties span the links."""
    src, dst = [], []
    size = np.bincount(run)
    first = np.cumsum(size) - size
    pair = np.flatnonzero(size == 2)
    a, b = fp[first[pair]], fp[first[pair] + 1]
    near = _linked(a, b, bits)
    src.append(b[near]), dst.append(a[near])
    many = np.flatnonzero(size > 2)
    for r in many:
        x = fp[first[r] : first[r] + size[r]]
        free = [8 * p + k for p in range(8) if p not in _SETS[int(family[first[r]])] for k in range(8)]
        if len(x) <= 24:
            i, j = np.triu_indices(len(x), 1)
            ok = _linked(x[i], x[j], bits)
            i, j = i[ok], j[ok]
            root = np.arange(len(x))
            for u, v in zip(i.tolist(), j.tolist(), strict=True):
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                if u != v:
                    root[max(u, v)] = min(u, v)
            tied = np.flatnonzero(root != np.arange(len(x)))
            src.append(x[tied]), dst.append(x[root[tied]])
            continue
        label = np.arange(len(x))
        for _ in range(len(x)):
            before = label.copy()
            for hidden in combinations(free, bits):
                _, group = np.unique(x & ~np.uint64(sum(1 << h for h in hidden)), return_inverse=True)
                least = np.full(group.max() + 1, len(x))
                np.minimum.at(least, group, label)
                label = np.minimum(label, least[group])
            if (before == label).all():
                break
        tied = np.flatnonzero(label != np.arange(len(x)))
        src.append(x[tied]), dst.append(x[label[tied]])
    return np.concatenate(src), np.concatenate(dst)


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(src, dst): a spanning forest, list by list, of the links between distinct fingerprints. fps: distinct (fp)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, m in enumerate(MASKS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array((fp & m).view(np.int64)), pa.array(fp.view(np.int64))], names=["family", "bytes", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(parts: list[np.ndarray]) -> pa.RecordBatch:
            family, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.ones(len(fp), bool)
            new[1:] = (family[1:] != family[:-1]) | (key[1:] != key[:-1])
            run = np.cumsum(new) - 1
            shared = np.bincount(run)[run] > 1
            src, dst = _forest(fp[shared].view(np.uint64), np.unique(run[shared], return_inverse=True)[1], family[shared], bits) if shared.any() else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(part[0]):
                continue
            last = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the batch's last list may go on in the next batch
            if cut:
                yield close([*held, [x[:cut] for x in part]])
                held = []
            elif held and (held[-1][0][-1] != part[0][0] or held[-1][1][-1] != part[1][0]):
                yield close(held)
                held = []
            held.append([x[cut:] for x in part])
        if held:
            yield close(held)

    posted = fps.select("fp").mapInArrow(post, "family int, bytes long, fp long").repartition("family", "bytes").sortWithinPartitions("family", "bytes", "fp")
    return posted.mapInArrow(verify, "src long, dst long").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): root is the least node reachable, for every node that has an edge to another.

    Alternating large-star and small-star steps; each keeps the edges' number bounded by the previous one, and each
    round is written to the shared folder, so that a lost executor costs one round."""
    shared_dir(edges.sparkSession)
    both = lambda e: e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("dst", "src"))
    e = save(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct(), label)
    while True:
        near = both(e)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.filter("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        new = save(small.filter("src <> dst").distinct(), label)
        drop(e)
        # done when every edge leads to a root: no node is both a source of one edge and the end of another, nor has two ends
        open_ = new.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() or new.select(F.col("dst").alias("src")).distinct().join(new.select("src"), "src", "left_semi").limit(1).count()
        e = new
        if not open_:
            return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id among documents reachable over links."""
    fp = save(fingerprints(docs, id_col), "simhash-fp")
    nodes = fp.groupBy("fp").agg(F.min(id_col).alias("least"))
    root = components(links(nodes, bits), "simhash-cc").withColumnRenamed("node", "fp")
    placed = save(nodes.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return fp.join(named, "fp").select(id_col, "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents' own columns: of each component, the row with the smallest id, nulls last (of repeated rows, one)."""
    rows = keyed(boxed(docs), columns=("text", "row"), label="simhash-keyed")
    groups = near_duplicates(rows.select("rid", "text"), "rid").select("rid", "component_id")
    first = rows.select("rid", "doc_id").join(groups, "rid").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("one"))
    return unboxed(rows.join(first.select(F.col("one.rid").alias("rid")), "rid", "left_semi"), docs)
