"""Incremental ingestion: a ledger of inputs, and a watermark over space.

Inputs are dispatched in the order of their bounding boxes' least Morton codes. The done-Morton bound is the least code
that an input still to come can hold; nodes wholly below it are final, and points that arrive below it later are late.
ingest() stores the batches; whenever the bound has advanced, a pass builds the samples of the interior nodes that have
become final since the last one, and writes them as a band. A node is in one band only, and a band never changes.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import lod, octree, running

ALL_DONE = (1 << 63) - 1


def done_morton(ledger: DataFrame) -> DataFrame:
    """One row (done_morton): null where nothing is certain, ALL_DONE where all inputs are done.

    ledger: name, input_order, morton_min, read_started, read_finished, sub_count, inserted; order 0 is unknown."""
    done = F.col("read_finished") & (F.col("inserted") == F.col("sub_count"))
    state = ledger.withColumn("done", done).withColumn("bound", F.least("morton_min", "input_order"))
    pending = F.when(F.col("read_started") & ~F.col("done"), F.struct("input_order", "name", "bound"))
    got = state.agg(
        F.min(pending).alias("pending"), F.min(F.when(F.col("read_started"), F.struct("input_order", "name", "done"))).alias("first"),
        F.min(F.when(~F.col("read_started"), F.col("input_order"))).alias("waiting"), F.count(F.when(F.col("read_started"), True)).alias("dispatched"),
    )
    bound = F.least(F.coalesce(F.col("pending.bound"), F.lit(ALL_DONE)), F.coalesce("waiting", F.lit(ALL_DONE)))
    known = (F.col("dispatched") > 0) & F.col("first.done") & (bound > 0)
    return got.select(F.when(known, bound).alias("done_morton"))


def final_nodes(tree: DataFrame, bound: int | None) -> DataFrame:
    """tree with state: 'final' where the cell's greatest code is below the bound."""
    from lattica.functions.morton import cell_max

    return tree.withColumn("state", F.when(cell_max("key", F.col("lod")) < F.lit(-1 if bound is None else bound), "final").otherwise("building"))


def late(points: DataFrame, bound: int | None) -> DataFrame:
    """Points below a bound that was already given out."""
    return points.filter(F.col("morton") < F.lit(-1 if bound is None else bound))


def bands(finals: DataFrame, passes: list[int]) -> DataFrame:
    """finals with band: the first of the ascending bounds that makes a node final; null if none does."""
    from lattica.functions.morton import cell_max

    out = F.lit(None).cast("int")
    for k in range(len(passes) - 1, -1, -1):
        out = F.when(cell_max("key", F.col("lod")) < F.lit(passes[k]), F.lit(k)).otherwise(out)
    return finals.withColumn("band", out)


def skip_done(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Inputs that the ledger doesn't hold as finished."""
    return candidates.join(ledger.filter("read_finished and inserted = sub_count").select("name"), "name", "left_anti")


def dispatch_order(inputs: DataFrame) -> DataFrame:
    """inputs with input_order (the code of the box's least corner) and their place in the queue."""
    from lattica.functions.morton import encode

    coded = inputs.withColumn("input_order", encode("min_gx", "min_gy", "min_gz"))
    return running.before(coded.withColumn("one", F.lit(1)), [F.col("input_order"), F.col("name")], {"place": "one"}).drop("one")


def states(ledger: DataFrame) -> DataFrame:
    """(state, inputs, parts, inserted): how many inputs wait, are being read, wait for their parts, or are done."""
    done = F.col("read_finished") & (F.col("inserted") == F.col("sub_count"))
    state = F.when(done, "done").when(F.col("read_finished"), "inserting").when(F.col("read_started"), "reading").otherwise("waiting")
    return ledger.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("inputs"), F.sum("sub_count").alias("parts"), F.sum("inserted").alias("inserted"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_band(points: DataFrame, out: str, band: int, bound: int | None, limit: int, full_detail: int = 9) -> DataFrame | None:
    """Write the samples of the interior nodes that are final at `bound` and in no earlier band, as `out`/band=<band>;
    returns their table, or None where nothing is final.

    Only points below the bound matter: a final node has all of its points there, and so have its ancestors those that
    make them interior. A band that is written again overwrites its own folder alone."""
    spark = points.sparkSession
    below = late(points, bound)
    if bound is None or below.isEmpty():
        return None
    tree = running.settled(octree.nodes(below, limit))
    ready = final_nodes(tree, bound).filter("state = 'final' and not is_leaf").select("lod", "key")
    earlier = [f"{out}/band={k}" for k in range(band) if _exists(spark, f"{out}/band={k}/_SUCCESS")]
    if earlier:
        ready = ready.join(spark.read.parquet(*earlier).select("lod", "key").distinct(), ["lod", "key"], "left_anti")
    samples = lod.pyramid(lod.slim(below), tree, full_detail).join(ready, ["lod", "key"], "left_semi")
    samples.write.mode("overwrite").parquet(f"{out}/band={band}")
    return spark.read.schema(samples.schema).parquet(f"{out}/band={band}")


class Passes:
    """Called after each stored batch (ingest's on_batch): runs a pass whenever the bound that `bound_of` gives has
    advanced. A band that fails `attempts` times is parked: its nodes stay undone, and the next pass takes them."""

    def __init__(self, spark: SparkSession, stored: str, out: str, bound_of: Callable[[int], int | None], limit: int, full_detail: int = 9, attempts: int = 5):
        self.spark, self.stored, self.out, self.bound_of = spark, stored, out, bound_of
        self.limit, self.full_detail, self.attempts = limit, full_detail, attempts
        self.bound: int | None = None
        self.parked: dict[int, str] = {}

    def __call__(self, _: DataFrame, batch: int) -> None:
        bound = self.bound_of(batch)
        if bound is None or (self.bound is not None and bound <= self.bound):
            return
        for attempt in range(self.attempts):
            try:
                build_band(self.spark.read.parquet(self.stored).drop("batch"), self.out, batch, bound, self.limit, self.full_detail)
            except Exception as e:  # whatever the store or a lost executor raises
                self.parked[batch] = str(e)
                time.sleep(min(0.5 * 2**attempt, 4.0) if attempt + 1 < self.attempts else 0)
            else:
                self.parked.pop(batch, None)
                self.bound = bound
                return


def ingest(spark: SparkSession, source: DataFrame, out: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """A streaming query that appends batches of points to `out`, one folder a batch; a repeated batch overwrites its own."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if on_batch:
            on_batch(df, batch)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def same_dataset(cache_uuid: str | None, destination_uuid: str | None) -> None:
    """A cache may feed a destination that is empty or of its own dataset."""
    if destination_uuid is not None and cache_uuid != destination_uuid:
        raise RuntimeError(f"the destination holds another dataset ({destination_uuid})")


def resume(ledger: DataFrame) -> DataFrame:
    """The ledger as a restart finds it: inputs dispatched but not done are read again from their start."""
    done = F.col("read_finished") & (F.col("inserted") == F.col("sub_count"))
    started = F.col("read_started") & done
    return ledger.withColumn("inserted", F.when(done, F.col("inserted")).otherwise(0)).withColumn("read_finished", done).withColumn("read_started", started)
