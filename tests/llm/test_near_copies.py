"""Near copies against brute force over all pairs."""

import random

import pytest

from lattica.llm import near_copies


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, bool(w)))}


def _planted():
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    line = r.choices(words, k=40)  # in many texts that are no copies
    texts = []
    for k in range(12):
        base = r.choices(words, k=r.choice([8, 30, 64, 200, 400])) + (line if k % 2 else [])
        for _ in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    return [*texts, "", None, "  ", "One two", "one  TWO", "one two three"]


@pytest.mark.parametrize("long", [2, 64])
def test_near_copies_match_brute_force(spark, long):
    texts = _planted()
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    want = {min(k for k, x in enumerate(root) if x == c) for c in set(root)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert len(want) < len(texts) - 10
    assert {x["doc_id"] for x in near_copies.representatives(docs, long).collect()} == want


def test_second_search_goes_on_from_the_groups_of_simhash(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(6):
        base = r.choices(words, k=300)
        for place in range(10):
            texts.append(" ".join([*base[: 30 * place], r.choice(words), *base[30 * place + 1 :]]))
    fp = near_copies.majority(*near_copies.word_hashes([t.encode() for t in texts]))
    group = list(range(60))  # by brute force: what the fingerprints tie together
    for i in range(60):
        for j in range(i):
            if (int(fp[i]) ^ int(fp[j])).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if x == group[i] else x for x in group]
    assert len(set(group)) < 10 and all(g // 10 == k // 10 for k, g in enumerate(group))
    left, pairs = [], near_copies._pairs

    def spy(*args):
        out = pairs(*args)
        left.extend((x["a"], x["b"]) for x in out.collect())
        return out

    monkeypatch.setattr(near_copies, "_pairs", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = lambda: {x["doc_id"] for x in near_copies.representatives(docs).collect()}
    assert kept() == set(range(0, 60, 10))
    assert all(group[a] != group[b] for a, b in left)  # what SimHash tied together isn't searched or checked again
    left.clear()
    monkeypatch.setattr(near_copies, "_near_fingerprints", lambda ones: spark.createDataFrame([], "a long, b long"))
    assert kept() == set(range(0, 60, 10))
    assert len(set(left)) >= 54  # without them all these links are the second search's


def test_pipeline_stage_removes_near_copies(spark):
    import corpus_pipeline

    r = random.Random(6)
    base = [f"w{r.randrange(5000)}" for _ in range(64)]
    copy = [*base[:-1], "another"]
    docs = spark.createDataFrame([(2, " ".join(base), "a"), (56, " ".join(copy), "b"), (57, " ".join(reversed(base)), "c")], "doc_id long, text string, source string")
    assert {(x["doc_id"], x["source"]) for x in corpus_pipeline.one_of_each_group(spark, docs, "").collect()} == {(2, "a"), (57, "c")}
