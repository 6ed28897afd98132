"""What several training-data operators share: tables, shared scratch space, row identity, text blocks and label samples."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes of an Arrow batch that Spark hands to Python: rows may be of any length, so their number bounds nothing.
BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> SparkSession:
    """Tasks hold a batch in the JVM, in Python as Arrow and in Python as texts; let batches be small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, where no other machine has to
    see it, one of our own will do if that is unset."""
    lean(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/lattica-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lattica/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder (in folders by these columns) and read them back."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by save() that no later plan reads, and let Spark free the shuffles that led to it."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._lattica_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished plans go once the JVM has collected their handles; ask for that between large steps."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def in_fold(key: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves the remainder; a null id counts as empty text."""
    text = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def keyed(docs: DataFrame, id_col: str = "doc_id", columns: Sequence[str] = ("text",), label: str = "keyed") -> DataFrame:
    """(rid long, id_col, *columns): rid names one row. It is the id itself where ids are whole numbers, unique and not
    null; otherwise the rows are numbered once in a written table, so that every later read sees the same numbers."""
    docs = docs.select(id_col, *columns)
    number = lambda: save(docs.select(F.monotonically_increasing_id().alias("rid"), id_col, *columns), label)
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        return number()
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).count() == 0:
        return docs.select(F.col(id_col).cast("long").alias("rid"), id_col, *columns)
    return number()


def boxed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the other columns as one struct, so that their names can't clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def unboxed(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` again. A column `chars` of df, where it isn't null, is the text's new n_chars."""
    kinds = dict(like.dtypes)
    chars = lambda n: [F.col("chars").cast(kinds[n])] if "chars" in df.columns and n == "n_chars" else []
    return df.select(*(F.col("text") if n == "text" else F.coalesce(*chars(n), F.col(f"row.`{n}`")).alias(n) for n in like.columns))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if column.type in (pa.string(), pa.binary()) else pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        texts = texts_of(batch.column(text))
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= limit:
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end
    give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Words:
    """White-space words of a block of texts, as positions in one buffer where each text ends with a line feed."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=self.n) + 1
        self.doc_end = np.cumsum(sizes)
        self.doc_start = self.doc_end - sizes
        self.black = ~WHITE[self.buf]
        edge = np.flatnonzero(np.diff(self.black.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hash_ranges(self.buf[self.black], self.end - self.start)

    def trimmed(self, marks: np.ndarray, most: int = 8, characters: int = 0) -> np.ndarray:
        """The hashes of the words without up to `most` bytes of the table `marks` at either end; characters: of so
        many first ones only."""
        start, end = self.start.copy(), self.end.copy()
        for _ in range(most):
            cut = (start < end) & marks[self.buf[start]]
            if not cut.any():
                break
            start += cut
        for _ in range(most):
            cut = (start < end) & marks[self.buf[end - 1]]
            if not cut.any():
                break
            end -= cut
        if characters:
            heads = np.flatnonzero((self.buf & 0xC0) != 0x80)
            k = np.searchsorted(heads, start) + characters
            end = np.where(k < len(heads), np.minimum(end, heads[np.minimum(k, len(heads) - 1)]), end)
        size = end - start
        inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        out = np.zeros(len(size), np.uint64)
        out[size > 0] = hash_ranges(self.buf[inside], size[size > 0])
        return out


def hash_ranges(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, none of them empty, that follow one another in data."""
    if not len(size):
        return np.zeros(0, np.uint64)
    at = np.cumsum(size) - size
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, dtype=np.uint64)
    power[0] = 0xD6E8FEB86659FD93
    np.multiply.accumulate(power, out=power)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(at, size)
    return mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], at) + size.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, fold: int = 5, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y): at most `rows` labelled documents outside fold remainder 0, chosen by a hash of the id alone;
    of these, with `most_bytes`, as many as hold so much text together, those of a 64th of it or less first.

    The bound is what lets the ids be broadcast. Null ids and null labels are left out; an id labelled twice counts
    once, with its larger label; an id of several documents gives the first of them by text."""
    picked = (
        labels.select("doc_id", F.col(target).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~in_fold("doc_id", fold, 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    if most_bytes is None:
        return sample
    size = F.octet_length("text").cast("long")
    order = Window.orderBy(size > most_bytes // 64, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over `rows` rows at most
    return sample.withColumn("upto", F.sum(size).over(order)).filter(F.col("upto") <= most_bytes).drop("upto")
