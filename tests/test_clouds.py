"""Point-cloud operators: Morton algebra, octree, level of detail, region and camera queries, codecs, ingestion."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions import frame
from lattica.functions import morton as M
from lattica.operators import codec, frustum, lod, octree, region, schema, stats
from lattica.plans import queries as Q
from lattica.sources import dataset, las, sinks
from lattica.streaming import ledger

SF = "/root/testdata/sf0.001"


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple("NULL" if r[i] is None else (round(float(r[i]), 9) if isinstance(r[i], float) else str(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), want.columns)


@pytest.mark.parametrize("stretch", [1, 50])
def test_nodes_from_short_stretches(spark, con, monkeypatch, stretch):
    monkeypatch.setattr(octree, "STRETCH", stretch)
    df = Q.QUERIES["octree_nodes"](spark, SF)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(con.sql(Q.SQL["octree_nodes"]).fetchall(), df.columns)


def test_nodes_hold_no_whole_range():
    """A task's range of cells is as long as it likes: nodes come before it is read to its end, and are the same."""
    key = np.unique(np.random.default_rng(5).integers(0, 1 << 24, 300_000))
    cells = {"key": key, "n": key % 5 + 1, "low": key << 3, "high": (key << 3) + 7, "mask": key % 255 + 1} | {e: key + i for i, e in enumerate(octree._EXTENTS)}
    table = pa.table(cells)
    read = []

    def batches(rows):
        for b in table.to_batches(max_chunksize=rows):
            read.append(b.num_rows)
            yield b

    def added(got):
        t = pa.Table.from_batches(got).group_by(["lod", "key"]).aggregate([("n", "sum"), ("low", "min"), ("high", "max"), *((e, e[:3]) for e in octree._EXTENTS)])
        n = {(r["lod"], r["key"]): r for r in t.to_pylist()}
        return {k: r for k, r in n.items() if k[0] == 9 or n.get((k[0] + 1, k[1] >> 3), {"n_sum": 0})["n_sum"] > 256}

    first = next(octree._range_tree(256, 9)(batches(20_000)))
    assert first.num_rows and sum(read) <= 100_000 < len(key)
    whole = added(octree._range_tree(256, 9)(batches(len(key))))
    want = {(9, 0): int(cells["n"].sum())}
    for lod in range(8, -1, -1):
        at, where = np.unique(key >> 3 * lod, return_inverse=True)
        n = np.bincount(where, cells["n"])
        want |= {(lod, k): int(m) for k, m in zip(at.tolist(), n, strict=True) if want.get((lod + 1, k >> 3), 0) > 256}
    assert {k: r["n_sum"] for k, r in whole.items()} == want
    assert added(octree._range_tree(256, 9)(batches(7_001))) == whole


@pytest.fixture(scope="module")
def grid(spark):
    """All of 0..23 on three axes, x fastest."""
    i = F.col("id")
    cube = spark.range(24**3).select("id", (i % 24).alias("gx"), F.floor(i / 24 % 24).alias("gy"), F.floor(i / 576).alias("gz"))
    return cube.withColumn("intensity", (F.col("gx") + F.col("gy") * 8).cast("int")).withColumn("morton", M.encode("gx", "gy", "gz")).cache()


def test_morton_vectors(spark):
    rows = spark.createDataFrame([(1, 2, 3, 53), (24, 24, 24, 32256), ((1 << 20) - 1,) * 3 + ((1 << 60) - 1,)], "x long, y long, z long, m long")
    for r in rows.select("*", M.encode("x", "y", "z").alias("got"), *(c.alias(n) for n, c in zip("abc", M.decode("m"), strict=True))).collect():
        assert r["got"] == r["m"] and (r["a"], r["b"], r["c"]) == (r["x"], r["y"], r["z"])


def test_wide_codes_round_trip_and_order(spark):
    rng = np.random.default_rng(44)
    rows = [tuple(int(v) for v in rng.integers(0, 1 << 42, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("m", M.encode_wide("x", "y", "z"))
    got = df.select("x", "y", "z", *(c.alias(n) for n, c in zip("abc", M.decode_wide("m"), strict=True)), "m").collect()
    assert all((r["x"], r["y"], r["z"]) == (r["a"], r["b"], r["c"]) for r in got)
    code = lambda p: sum(((v >> k) & 1) << (3 * k + a) for a, v in enumerate(p) for k in range(42))
    assert [(r["m"]["hi"], r["m"]["lo"]) for r in got] == [(code((r["x"], r["y"], r["z"])) >> 63, code((r["x"], r["y"], r["z"])) & ((1 << 63) - 1)) for r in got]


def test_grid_boxes(grid):
    count = lambda low, high: grid.filter(region.inside(region.Box(low, high))).count()
    assert count((-1,) * 3, (25,) * 3) == 13824
    assert count((3.75,) * 3, (12.25,) * 3) == 729
    assert count((4,) * 3, (12,) * 3) == 729
    assert count((7,) * 3, (7,) * 3) == 13824  # an empty box stands for everything


def test_leaves_partition_the_points(grid):
    tree = octree.nodes(grid, 900)
    leaves = tree.filter("is_leaf")
    assert leaves.agg(F.sum("n")).first()[0] == 13824 and leaves.agg(F.max("n")).first()[0] <= 900
    placed = octree.leaf_of_point(grid, 900, tree).groupBy("leaf_lod", "leaf_key").count()
    assert {tuple(r) for r in placed.collect()} == {(r["lod"], r["key"], r["n"]) for r in leaves.collect()}


def test_frontier_has_no_ancestors(grid):
    tree = octree.nodes(grid, 900).cache()
    for front in (region.frontier_level(tree, 3, octree.root(grid)), region.frontier_budget(tree, 3000)):
        keys = {(r["lod"], r["key"]) for r in front.collect()}
        assert keys and not any((up, key >> 3 * (up - lod_)) in keys for lod_, key in keys for up in range(lod_ + 1, 10))


def test_sample_sizes_need_no_iteration(grid):
    tree = octree.nodes(grid, 900)
    got = {(r["lod"], r["key"]): r["n"] for r in lod.pyramid(grid, tree, 2).groupBy("lod", "key").agg(F.count(F.lit(1)).alias("n")).collect()}
    median = lod.median_pyramid(grid.select("id", "morton"), tree, 2).groupBy("lod", "key").agg(F.count(F.lit(1)).alias("n")).collect()
    assert got and {(r["lod"], r["key"]): r["n"] for r in median} == got


def test_constant_cloud_stays_one_leaf(spark):
    same = spark.range(4096).select("id", *(F.lit(0).cast("long").alias(a) for a in ("gx", "gy", "gz")), F.lit(0).cast("long").alias("morton"))
    tree = octree.nodes(same, 256)
    assert [(r["lod"], r["n"]) for r in tree.filter("is_leaf").collect()] == [(0, 4096)]


def test_quantize_truncates_and_refuses_what_is_outside(spark):
    c = frame.CloudConfig(scale=0.5, offset=(0.0, 0.0, 0.0))
    ok = frame.on_grid(spark.createDataFrame([(1.9, 0.4, 0.5)], "x double, y double, z double"), c).first()
    assert (ok["gx"], ok["gy"], ok["gz"]) == (3, 0, 1)
    with pytest.raises(Exception, match="outside the dataset range"):
        frame.on_grid(spark.createDataFrame([(-1.0, 0.0, 0.0)], "x double, y double, z double"), c).collect()


def test_planes_of_a_view(spark):
    p = frustum.planes(np.eye(4))
    rows = spark.createDataFrame([(0.0, 0.5) * 3, (2.0, 3.0) * 3, (0.5, 2.0) * 3], ", ".join(f"{n}_{a} double" for a in ("gx", "gy", "gz") for n in ("min", "max")))
    assert [r[0] for r in rows.select(frustum.classify(p)).collect()] == ["inside", "outside", "intersects"]


def test_codec_inverses(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(i) % 3, int(i), int(v)) for i, v in enumerate(rng.integers(0, 65536, 300))], "u int, i int, v int")
    back = codec.undelta(codec.delta(df, "v", ["u"], ["i"], "d", 65536), "d", ["u"], ["i"], "back", 65536)
    assert back.filter("back <> v").count() == 0
    assert {r["u"]: r["ascending"] for r in codec.monotonic(df, "i", ["u"], ["i"]).collect()} == {0: True, 1: True, 2: True}
    kept = codec.sort_permutation(codec.offset(df, "v", ["u"]), "v", ["u"], ["i"])
    assert kept.filter("rest + base <> v").count() == 0 and kept.select("u", "rank").distinct().count() == 300


def test_encoded_units_come_back(spark):
    rng = np.random.default_rng(8)
    n = 3000
    cols = {"rising": np.arange(n) * 1000 + rng.integers(0, 9, n), "same": np.full(n, 7), "high": (1 << 40) + rng.integers(0, 100, n), "noise": rng.integers(-(1 << 62), 1 << 62, n)}
    assert {k: codec.encode(v)[0] for k, v in cols.items()}["same"] == "constant"
    for v in [*cols.values(), rng.random(n), np.array([0.0, -0.0, np.nan, np.inf]), np.array([5], np.int16), rng.integers(0, 9, 50).astype(np.float32)]:
        path, data = codec.encode(v)
        assert codec.decode(path, data, len(v), v.dtype).tobytes() == v.tobytes()
        assert len(data) <= len(v.tobytes()) + 40
    assert len(codec.encode(cols["same"])[1]) * 20 < n  # a column of one value
    assert np.array_equal(codec.unshuffled(codec.shuffled(cols["noise"]), np.dtype("i8")), cols["noise"])
    df = spark.createDataFrame([(int(i % 3), int(i), float(x), int(y)) for i, (x, y) in enumerate(zip(rng.random(300), rng.integers(0, 99, 300), strict=True))], "u int, i long, x double, y smallint")
    units = codec.encoded(df, ["i", "x", "y"], ["u"], ["i"])
    assert units.count() == 9
    assert sorted(map(tuple, codec.decoded(units, ["i", "x", "y"], ["u"]).collect())) == sorted(map(tuple, df.collect()))


def test_tree_in_ranges_equals_all_levels(spark):
    """Skewed, clustered and constant clouds, in many ranges: the same nodes as from every prefix at every level."""
    rng = np.random.default_rng(11)
    some = np.concatenate([rng.integers(0, 4000, (600, 3)), rng.integers(100, 130, (900, 3)), np.full((500, 3), 77)])
    df = spark.createDataFrame([(int(i), *map(int, p)) for i, p in enumerate(some)], "id long, gx long, gy long, gz long").withColumn("morton", M.encode("gx", "gy", "gz")).repartition(6).cache()
    key = lambda t, *more: {(r["lod"], r["key"], r["n"], r["low"], r["high"], r["child_mask"], r["min_gx"], r["max_gz"]) for r in t.collect()}
    every = octree.levels(df)
    for limit in (1, 40, 5000):
        tree = octree.nodes(df, limit)
        over = {(r["lod"], r["key"]) for r in every.collect() if r["n"] > limit}
        top = octree.root(df)
        want = {k for k in key(every) if k[0] == top or all((up, k[1] >> 3 * (up - k[0])) in over for up in range(k[0] + 1, top + 1))}
        assert key(tree) == want
        placed = {r["id"]: (r["leaf_lod"], r["leaf_key"]) for r in octree.leaf_of_point(df, limit, tree).collect()}
        small, octree.SMALL_TREE = octree.SMALL_TREE, 0
        try:
            assert {r["id"]: (r["leaf_lod"], r["leaf_key"]) for r in octree.leaf_of_point(df, limit, tree).collect()} == placed
        finally:
            octree.SMALL_TREE = small
    assert {r["width"]: r["cells"] for r in octree.occupied(df, [0, 2, 5]).collect()} == {w: df.select(M.prefix("morton", w)).distinct().count() for w in (0, 2, 5)}


def test_refinement_follows_the_centre_and_holds(spark):
    node = spark.createDataFrame([(0.0, 100.0) * 3], ", ".join(f"{n}_{a} double" for a in ("gx", "gy", "gz") for n in ("min", "max")))
    half = np.sqrt(3) * 50
    for distance, threshold, h, before, want in ((half - 1, 1e9, 0, None, True), (half + 1, 1e9, 0, None, False), (1000, 0.5 * half / 1000 - 1e-6, 0, None, True), (1000, 0.5 * half / 1000 + 1e-6, 0, None, False), (1000, 0.5 * half / 900, 0.2, True, True), (1000, 0.5 * half / 900, 0.2, False, False)):
        eye = (50.0 + distance, 50.0, 50.0)
        assert node.select(frustum.refines(eye, 1.0, threshold, h, None if before is None else F.lit(before))).first()[0] is want


def test_missing_colour_is_grey(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0, None), (2, 0, 0, 0, 0, [1, 2, 3])], "id long, gx long, gy long, gz long, morton long, rgb array<int>")
    assert [(r["rgb"], r["red"], r["intensity"]) for r in region.project(df, ["rgb", "red", "intensity"]).orderBy("id").collect()] == [([200] * 3, 200, 0), ([1, 2, 3], 200, 0)]
    assert region.project(df.drop("rgb"), ["rgb"]).first()["rgb"] == [200] * 3


def test_schema_union_widens_and_fills(spark):
    a = spark.createDataFrame([(1, 5)], "id long, intensity int")
    b = spark.createDataFrame([(2, 7.5, 3.0)], "id long, intensity double, gps_time double")
    assert [tuple(r) for r in schema.union(a, b).orderBy("id").collect()] == [(1, 5.0, 0.0), (2, 7.5, 3.0)]
    got = spark.createDataFrame([([1, 300, 70000, -1],)], "c array<bigint>").select(*(schema.components(F.col("c"), 5, k).alias(k) for k in ("smallint", "tinyint", "double"))).first()
    assert got["smallint"] == [1, 300, 70000 - 65536, -1, 0] and got["tinyint"] == [1, 44, 112, -1, 0] and got["double"] == [1.0, 300.0, 70000.0, -1.0, 0.0]
    got = spark.createDataFrame([([1.9, -1.9, float("nan"), 300.5],)], "c array<double>").select(schema.components(F.col("c"), 3, "tinyint", "double").alias("a"), schema.components(F.col("c"), 4, "smallint", "double").alias("b")).first()
    assert got["a"] == [1, -1, 0] and got["b"] == [1, -1, 0, 300]


def _led(spark, rows):
    return ledger.done_morton(spark.createDataFrame(rows, "name string, input_order long, morton_min long, read_started boolean, read_finished boolean, sub_count int, inserted int")).first()[0]


def test_done_morton_rules(spark):
    big = ledger.ALL_DONE
    assert _led(spark, [("a", 10, big, False, False, 0, 0)]) is None
    assert _led(spark, [("a", 10, 10, True, False, 1, 0), ("b", 20, 20, True, True, 1, 1)]) is None
    assert _led(spark, [("a", 10, 10, True, True, 1, 1), ("b", 20, 25, True, False, 1, 0)]) == 20
    assert _led(spark, [("a", 10, 10, True, True, 1, 1), ("b", 20, 20, True, True, 2, 2)]) == big
    assert _led(spark, [("a", 10, 10, True, True, 1, 1), ("b", 15, big, False, False, 0, 0)]) == 15
    assert _led(spark, [("a", 10, 10, True, True, 1, 1), ("b", 0, big, False, False, 0, 0)]) is None


def test_incremental_equals_single_pass(spark, grid, tmp_path):
    src = str(tmp_path / "src")
    grid.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(grid.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ledger.ingest(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    key = lambda t: {(r["lod"], r["key"], r["n"], r["is_leaf"]) for r in t.select("lod", "key", "n", "is_leaf").collect()}
    assert key(octree.nodes(got, 900)) == key(octree.nodes(grid, 900))


def test_bands_hold_each_final_node_once(spark, grid, tmp_path):
    """Rising inputs: a pass a batch; at the end all interior nodes are built, as one pass over everything builds them."""
    src, stored, out = (str(tmp_path / n) for n in ("src", "stored", "bands"))
    grid.select("id", "gx", "gy", "gz", "morton").repartitionByRange(4, "morton").write.parquet(src)
    files = sorted(glob.glob(f"{src}/*.parquet"))
    lows = [spark.read.parquet(f).agg(F.min("morton")).first()[0] for f in files]
    bounds = [*lows[1:], ledger.ALL_DONE]
    for k, f in enumerate(files):  # the order of dispatch
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    passes = ledger.Passes(spark, stored, out, lambda batch: bounds[batch], 300, 2)
    ledger.ingest(spark, stream, stored, str(tmp_path / "ck"), passes).awaitTermination(300)
    assert not passes.parked and passes.bound == ledger.ALL_DONE
    got = [(r["lod"], r["key"], r["cell"], r["morton"], r["id"]) for r in spark.read.parquet(out).collect()]
    tree = octree.nodes(grid, 300)
    want = [(r["lod"], r["key"], r["cell"], r["morton"], r["id"]) for r in lod.pyramid(lod.slim(grid), tree, 2).collect()]
    assert sorted(got) == sorted(want)
    bands = spark.read.parquet(out).groupBy("lod", "key").agg(F.count_distinct("band").alias("n")).collect()
    assert {r["n"] for r in bands} == {1} and spark.read.parquet(out).select("band").distinct().count() > 2
    failing = ledger.Passes(spark, str(tmp_path / "nothing"), out, lambda _: 5, 300, attempts=1)
    failing(None, 9)
    assert 9 in failing.parked and failing.bound is None


def test_running_totals_in_ranges(spark):
    from lattica.operators import running

    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 11).alias("v"), F.lit(1).alias("one"))
    got = {r["k"]: (r["s"], r["place"]) for r in running.before(df, [F.desc("k")], {"s": "v", "place": "one"}).collect()}
    total, want = 0, {}
    for k, v in sorted(((r["k"], r["v"]) for r in df.collect()), reverse=True):
        want[k] = (total, 4999 - k)
        total += v
    assert got == want


@pytest.mark.parametrize("kind", range(11))
def test_las_formats(spark, tmp_path, kind):
    path = str(tmp_path / f"f{kind}.las")
    n = 50
    fields = {"x": np.arange(n), "y": np.arange(n) * 2, "z": np.arange(n) * 3, "intensity": np.arange(n) * 1000, "classification": np.full(n, 200)}
    if ("red", "<u2") in las.FORMATS[kind]:
        fields["red"] = np.full(n, 65535)
    las.write(path, kind, fields)
    got = las.read(spark, path).orderBy("record").collect()
    assert len(got) == n and got[7]["x"] == pytest.approx(0.007) and got[7]["intensity"] == 7000 and got[7]["classification"] == 200
    h = las.headers(spark, path).first()
    assert (h["points"], h["point_format"]) == (n, kind) and h["max_z"] == pytest.approx(0.147)


def test_dataset_round_trip(spark, tmp_path):
    line = spark.range(4096).select((F.col("id") * 0.001).alias("x"), (F.col("id") % 7 * 0.001).alias("y"), (F.col("id") % 3 * 0.001).alias("z"), (F.col("id") % 100).cast("int").alias("intensity"))
    ds = dataset.build(line, str(tmp_path / "ds"), frame.CloudConfig(scale=0.001, offset=(0.0, 0.0, 0.0), node_point_limit=256, full_detail_level=2))
    whole = ds.query_box()
    assert whole["point_count"] == 4096 and whole["xyz"].shape == (4096, 3)
    part = ds.query_box((0, 0, 0), (1.0, 1.0, 1.0))
    assert 0 < part["point_count"] < 4096
    assert 0 < ds.query_box(lod="budget", max_points=512)["point_count"] <= 4096
    assert ds.query_box(lod="level", level=40)["node_count"] == 1
    assert set(ds.query_box(attributes=["nothing"])["nothing"]) == {0}
    assert ds.query_box(position_format="i32")["xyz"].dtype.kind == "i"
    with pytest.raises(ValueError):
        ds.query(lod_mode="half")
    with pytest.raises(ValueError):
        ds.query((0, 0), (1, 1))
    with pytest.raises(RuntimeError):
        dataset.open_dataset(spark, str(tmp_path / "none"))
    again = dataset.copy(ds, str(tmp_path / "copy"))
    assert again.config["uuid"] != ds.config["uuid"] and again.query_box()["point_count"] == 4096
    sinks.write_csv(ds.query().select("x", "y", "z", "intensity"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4096
    assert sum(len(r["bytes"]) for r in sinks.raw_buffers(ds.query(), ["x"]).collect()) == 4096 * 8
    assert ds.statistics().filter("attribute = 'intensity'").first()["max_value"] == 99
    import asyncio

    assert asyncio.run(ds.query_box_async())["point_count"] == 4096


def test_box_filter_reaches_the_scan(spark, tmp_path):
    line = spark.range(1000).select((F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    ds = dataset.build(line, str(tmp_path / "ds"), frame.CloudConfig(scale=1.0, offset=(0.0, 0.0, 0.0), node_point_limit=100))
    plan = ds.query((1, 0, 0), (5, 0, 0))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(gx" in plan and "PushedFilters" in plan


def test_statistics_helpers(spark):
    assert stats.attribute_registry(["xyz", "a"], ["xyz", "b", "a"]) == ["xyz", "a", "b"]


def test_requests(spark, grid):
    from lattica.sources.requests import Request

    seen = []
    r = Request(grid.filter("gx < 3").select("gx"), seen.append)
    assert r.wait(60) == "completed" and r.result().num_rows == 3 * 576 and r.completion == 1
    with pytest.raises(ValueError):
        r.copy_into("gx", memoryview(bytearray(8)))
    assert r.copy_into("gx", memoryview(bytearray(8 * 3 * 576))) == 8 * 3 * 576
    bad = Request(spark.range(1).select(F.raise_error(F.lit("no"))))
    assert bad.wait(60) == "failed" and "no" in bad.error
    slow = Request(spark.range(10**12).agg(F.bit_xor(F.xxhash64("id"))))
    assert slow.wait(0.5) == "pending"
    slow.cancel()
    assert slow.wait(60) == "canceled"


def test_locations(spark, tmp_path):
    from lattica.sources import locations

    assert locations.resolve("s3://b/k") == "s3a://b/k" and locations.resolve("/a/b") == "/a/b" and locations.resolve("az://c@h/k") == "abfss://c@h/k"
    with pytest.raises(ValueError):
        locations.resolve("ftp://x")
    (tmp_path / "store.properties").write_text("# of the test\nfs.lattica.a = 1\nfs.lattica.b = x=y\n\n")
    locations.configure(spark, str(tmp_path / "store.properties"))
    held = spark._jsc.hadoopConfiguration()
    assert (held.get("fs.lattica.a"), held.get("fs.lattica.b")) == ("1", "x=y")
    locations.configure(spark, {"fs.lattica.secret.key": "${env.PATH}"})
    assert held.getRaw("fs.lattica.secret.key") == "${env.PATH}" and held.get("fs.lattica.secret.key") == os.environ["PATH"]
    with pytest.raises(ValueError):
        locations.configure(spark, {"fs.azure.account.key.a.dfs.core.windows.net": "plain text"})


def test_restart_reads_unfinished_inputs_again(spark):
    led = spark.createDataFrame([("a", 1, 1, True, True, 2, 2), ("b", 2, 2, True, False, 2, 1)], "name string, input_order long, morton_min long, read_started boolean, read_finished boolean, sub_count int, inserted int")
    got = {r["name"]: (r["read_started"], r["inserted"]) for r in ledger.resume(led).collect()}
    assert got == {"a": (True, 2), "b": (False, 0)}
    with pytest.raises(RuntimeError):
        ledger.same_dataset("u1", "u2")


def test_command_line(spark, tmp_path, capsys):
    from lattica import cli

    las.write(str(tmp_path / "a.las"), 0, {a: np.arange(500) for a in "xyz"})
    assert cli.main(["convert", str(tmp_path / "a.las"), "-o", str(tmp_path / "ds"), "--node-limit", "100", "--scale", "0.001"], spark) == 0
    assert cli.main(["query", str(tmp_path / "ds"), "--aabb", "0,0,0,0.1,0.1,0.1", "--lod", "full"], spark) == 0
    for args in (["info", str(tmp_path / "ds")], ["extract", str(tmp_path / "ds"), "--nodes"], ["laz", str(tmp_path / "a.las"), "--points", "3"], ["copy", str(tmp_path / "ds"), str(tmp_path / "c")]):
        assert cli.main(args, spark) == 0
    assert "101" in capsys.readouterr().out
    assert cli.main(["query", str(tmp_path / "ds"), "--attributes", "intensity", "-o", f"file://{tmp_path}/raw", "--stats", "--memory", "16M"], spark) == 0
    assert sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/raw/x-*.bin")) == 500 * 8
    assert cli.main(["query", str(tmp_path / "ds"), "--lod", "8", "-o", f"file://{tmp_path}/nodes", "--per-node"], spark) == 0
    assert glob.glob(f"{tmp_path}/nodes/*-*/x-*.bin")
    node = spark.read.parquet(str(tmp_path / "ds" / "nodes")).filter("is_leaf").first()
    assert cli.main(["extract", str(tmp_path / "ds"), "--node", f"{node['lod']}:{node['key']}"], spark) == 0
    assert cli.main(["extract", str(tmp_path / "ds"), "--hex", "gx", "--count", "2"], spark) == 0
    assert "00000000  00 00 00 00" in capsys.readouterr().out
    assert cli.byte_size("64M") == 64 << 20 and cli.lod_mode("budget:9") == ("budget", 0, 9)
