"""The corpus pipeline, stage by stage, on the smallest tables."""

from pathlib import Path

import corpus_pipeline as P
from lattica.llm import common, decontam, packing, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"


def least_of_groups(texts):
    """Brute force: the least id of each group that five-word similarities of 0.8 tie together."""
    words = {d: (t or "").lower().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, bool(w)))} for d, w in words.items()}
    root = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return set(root.values())


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    labels, bench = common.table(spark, SF, "labels"), common.table(spark, SF, "benchmark")
    outs = []
    for _, stage in P.STAGES[:-1]:
        docs = common.save(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        outs.append(docs)
    clean, one, cut, decontaminated = outs
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    scored = toxicity.report(common.table(spark, SF, "documents"), labels)
    assert ids(clean) == ids(scored.filter("predicted = 0"))
    assert ids(one) == least_of_groups({r["doc_id"]: r["text"] for r in clean.collect()})
    assert ids(cut) == ids(one)
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.report(one).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (one, cut))
    for d in before:
        assert before[d] == after[d] if not removed[d] else len(after[d].encode()) >= len(before[d].encode()) - removed[d]
    assert ids(decontaminated) == ids(decontam.report(cut, bench).filter("not contaminated"))
    packed = P.STAGES[-1][1](spark, decontaminated, SF)
    assert ids(packed) == ids(decontaminated) and packed.columns == packing.report(decontaminated).columns


def test_run(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "lattica"
    before = set(folder.glob("pipeline-*"))
    rows = P.run(spark, SF).collect()
    assert rows and all(r["length"] <= 2048 for r in rows)
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.glob("pipeline-*")) - before] == ["pipeline-decontamination"]  # of the stages' tables the last alone


EDGE = "doc_id long, text string, rid long, row string, root long, score double, spans string, chars long, n_chars long"


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"word{k}" for k in range(90))
    rows = [(1, text), (1, text), (None, text), (None, None), (None, None), (5, ""), (6, "  "), (7, "x " * 40_000), (8, text + " end"), (9, "short")]
    docs = spark.createDataFrame([(d, t, 1, "r", 2, 0.5, "s", 3, len(t or "")) for d, t in rows], EDGE)
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = common.save(stage(spark, kept, SF), "test-edge")
        assert kept.columns == docs.columns, name
        assert all((r["rid"], r["row"], r["root"], r["spans"], r["chars"]) == (1, "r", 2, "s", 3) and r["n_chars"] == len(r["text"] or "") for r in kept.collect())
    one = P.one_of_each_group(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in one) == [("1", "word0"), ("5", ""), ("7", "x x x"), ("9", "short")]
    packed = P.pack(spark, kept, SF).collect()
    assert len({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and len(packed) >= kept.count()


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], EDGE)
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)
