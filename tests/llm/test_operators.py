"""The training-data operators against brute force, on small documents with nulls, empties, long texts, copies, ties,
repeated rows and columns whose names clash with the operators' own."""

import glob
import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import common, decontam, gsaca, lm, near_copies, packing, quality, queries, rules, simhash, suffix_dedup, toxicity, url_lists, warc

WS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, score double, key string, fp long, spans string, y int, h long"


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _documents():
    r = random.Random(7)
    vocab = [f"{a}{b}{c}" for a in "kdmtréß" for b in ("a", "o", "ün") for c in ("", "st", "ing", ".", ",", "日本")]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [text(r.randint(1, 120)) for _ in range(40)]
    rows += [rows[3], rows[3], rows[5] + " tail", "head " + rows[5]]
    passage = text(70)
    rows += [text(30) + " " + passage + " " + text(20) for _ in range(12)]
    near = text(400)
    rows += [near] + [" ".join(w if k != j * 37 else "other" for k, w in enumerate(near.split(" "))) for j in range(5)]
    rows += [None, "", " \t\n", "x", "ab " * 300, "a" * 3000, "a" * 2500, "#### $$ && | <b>", "one line here\none line here\n\n\none line here\n", text(9000), "é" * 400, "Ａ two\x85three four"]
    rows += ["THE Quick <|endoftext|> it's we'll 123 45 --- !!\r\n\x1c odd ²Ⅷ ــ\U0001f600"]
    out = [(i, t) for i, t in enumerate(rows)]
    out += [(2, rows[2]), (2, rows[2]), (3, "another text of id 3"), (None, text(40)), (None, None)]
    return out


DOCS = _documents()


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, 0.5, "k", 1, "s", 0, 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def unique(spark):
    return _frame(spark, [(i, t) for k, (i, t) in enumerate(DOCS) if i is not None and k == [a for a, _ in DOCS].index(i)]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 60)] + [(None, 1, 1), (4, None, None), (4, 1, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _by(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


# --- 1 ----------------------------------------------------------------------------------------------------------


def _brute_repeats(rows, length=200):
    seen = Counter((t or "").encode()[i : i + length] for _, t in rows for i in range(len((t or "").encode()) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark, end = np.zeros(len(b) + 1, bool), 0
        for i in range(len(b)):
            if i + length <= len(b) and seen[b[i : i + length]] > 1:
                end = i + length
            mark[i] = i < end
        out.append((d, len(b), int(mark.sum()), int((np.diff(mark.astype(int)) == 1).sum() + mark[0]), hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return _by(out)


@pytest.mark.parametrize("text_bytes", [1 << 15, 600])
def test_repeated_strings(docs, monkeypatch, text_bytes):
    """The small bound sends frequent anchors through every round of splitting."""
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", text_bytes)
    got = suffix_dedup.report(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert _by(tuple(r) for r in got) == _brute_repeats(DOCS)


def test_segments_have_each_start_once():
    """A text cut into segments that overlap by 199 bytes gives every start of the whole text, once."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(3000)).encode()
    for size in (700, 1 << 20):
        starts = []
        for at in range(0, len(base), size):
            _, start, n, *_ = suffix_dedup.cut_points([base[at : at + size + 199]])
            starts += [at + s + j for s, m in zip(start, n, strict=True) for j in range(m)]
        assert sorted(starts) == list(range(2801))


def test_pieces_left_out_of_the_sort_share_no_string():
    rng = random.Random(9)
    anchor = bytes(rng.randrange(97, 123) for _ in range(32))
    for _ in range(200):
        sides = [bytes(rng.randrange(97, 123) for _ in range(168)) for _ in range(3)]
        pieces = []
        for _ in range(rng.randint(2, 6)):
            low, high = sorted((rng.randint(0, 168), rng.randint(0, 168)))  # distances from a start to the anchor
            left, right = bytearray(rng.choice(sides)), bytearray(rng.choice(sides))
            if rng.random() < 0.7:
                left[rng.randrange(168)] = 65
                right[rng.randrange(168)] = 66
            data = bytes(left)[168 - high :] + anchor + bytes(right)[: 168 - low]
            pieces.append((1, len(pieces), 1, high, data))
        strings = [{p[4][k : k + 200] for k in range(len(p[4]) - 199)} for p in pieces]
        shares = {i for i, a in enumerate(strings) for j, b in enumerate(strings) if i != j and a & b}
        assert shares <= {p[1] for p in suffix_dedup.rivals(pieces)}


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for alphabet in (1, 2, 3, 20):
        for _ in range(30):
            texts = [np.append(rng.integers(1, alphabet + 1, rng.integers(0, 80)), 0) for _ in range(rng.integers(1, 6))]
            sa = gsaca.suffix_arrays(np.concatenate(texts), np.array([len(t) for t in texts]))
            at = 0
            for t in texts:
                assert (sa[at : at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:]))
                at += len(t)


def test_cut_texts_stay_text(unique):
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    got = suffix_dedup.cut(unique)
    assert got.columns == unique.columns
    for r in got.collect():
        assert (r["text"] is None) == (before[r["doc_id"]] is None) and len(r["text"] or "") == r["n_chars"]


# --- 2, 5, 10 ---------------------------------------------------------------------------------------------------


def test_quality_scores_every_row(docs, labels):
    got = quality.report(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_rule_ensemble_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = {n: rng.random(3000) for n in "abcd"}
    y = ((x["a"] > 0.5) & (x["b"] <= 0.3)).astype(float)
    model = quality.fit(x, y)
    z = model.bias + sum(w * r.of(x) for r, w in zip(model.rules, model.weights))
    assert ((z > 0) == (y == 1)).mean() > 0.98 and len(model.rules) < 60
    assert quality.fit(x, np.ones(3000)).rules == []


def test_quality_scores_match_the_rules(docs):
    """Compiled rules against the same rules over statistics made in Python."""

    def statistics(t):
        t = t or ""
        size, words, lines, tokens = max(len(t), 1), len(re.findall(WS, t)), t.split("\n"), re.split(r"[\x20\x09-\x0D]+", t)
        share = lambda chars: sum(map(t.count, chars)) / size
        return {
            "words": words, "chars_per_word": sum(c not in " \t\n\x0b\f\r" for c in t) / max(words, 1), "symbols": share("#*$%&|<>"), "bars": share("|"), "stops": share("."), "commas": share(","),
            "digits": share("0123456789"), "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "wide": (len(t.encode()) - len(t)) / size, "line_chars": size / len(lines),
            "distinct_lines": len(set(lines)) / len(lines), "distinct_words": len(set(tokens)) / len(tokens),
        }

    of = {k: statistics(t) for k, (_, t) in enumerate(DOCS)}
    middle = {n: float(np.median([s[n] for s in of.values()])) for n in of[0]}
    names = list(middle)
    model = quality.RuleModel([quality.Rule(((a, True, middle[a]), (b, False, middle[b]))) for a, b in zip(names, names[1:] + names[:1])], [0.3 * (-1) ** k * (k + 1) for k in range(len(names))], 0.1)
    want = []
    for k, (d, _) in enumerate(DOCS):
        z = model.bias + sum(w * all(of[k][n] > t if above else of[k][n] <= t for n, above, t in r.parts) for r, w in zip(model.rules, model.weights))
        want.append((d, round(1 / (1 + np.exp(-z)), 9)))
    assert len({p for _, p in want}) > 5
    assert _by((r["doc_id"], round(r["score"], 9)) for r in quality.score(docs, model).collect()) == _by(want)


def test_toxicity_scores_every_row(docs, labels):
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_learns_words_and_stems(spark):
    r = random.Random(2)
    plain = [f"w{k}" for k in range(300)]
    rows, lab = [], []
    for i in range(600):
        words = [r.choice(plain) for _ in range(60)]
        if i % 3 == 0:
            words[r.randrange(60)] = r.choice(["vilebad", f"grumpf{r.randrange(10**6)}", "Vilebad,"])
            words[r.randrange(60)] = f"grumpf{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        lab.append((i, 1, int(i % 3 == 0)))
    got = toxicity.report(_frame(spark, rows), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).filter("held_out").collect()
    right = [(r_["doc_id"] % 3 == 0) == bool(r_["predicted"]) for r_ in got]
    assert len(right) > 80 and np.mean(right) > 0.95


def test_toxicity_matches_brute_force(docs, labels, monkeypatch):
    """The log ratio of each word again, from counts made in Python; rare forms share the count of both classes."""
    model = toxicity.train(docs, labels)
    sample, _ = toxicity._sample(docs, labels, toxicity.SAMPLE_ROWS)
    marks = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())

    def read(t):
        out = []
        for w in (_lower(t)).encode().split():
            for _ in range(8):
                w = w[1:] if w[:1] and w[:1].decode("latin1") in marks else w
            for _ in range(8):
                w = w[:-1] if w[-1:] and w[-1:].decode("latin1") in marks else w
            out.append(w)
        return out

    def stems(w):
        text = w.decode()
        return [text[:k].encode() for k in toxicity.STEMS] + [w]

    pairs = [Counter(), Counter()]
    for r in sample.filter("counted").collect():
        w = read(r["text"])
        pairs[r["y"]].update((w[i - 1] if i else 0, w[i]) for i in range(len(w)))
    forms = [[Counter(stems(b)[k] for _, b in pairs[y]) for y in (0, 1)] for k in range(5)]
    heads = [Counter(), Counter()]
    cuts = [Counter(), Counter()]
    for y in (0, 1):
        for (a, _), n in pairs[y].items():
            heads[y][a] += n
            cuts[y][a] += min(n, toxicity.DISCOUNT)
    most = Counter()
    for y in (0, 1):
        for (a, _), n in pairs[y].items():
            most[a] = max(most[a], n)

    def ratio(before, w):
        p, above = [1.0, 1.0], sum(len(pairs[y]) for y in (0, 1))
        for k in range(5):
            n = [forms[k][y][stems(w)[k]] for y in (0, 1)]
            share = (sum(n) + 0.5) / (above + 1)
            p = [(max(n[y] - 3, 0) + sum(min(c, 3) for c in forms[k][y].values()) * p[y] * share) / len(pairs[y]) for y in (0, 1)]
            above = sum(n)
        if before != 0 and max(heads[0][before], heads[1][before]) and most[before] > 3:
            p = [(max(pairs[y][(before, w)] - 3, 0) + cuts[y][before] * p[y]) / heads[y][before] if heads[y][before] else p[y] for y in (0, 1)]
        return np.log(p[1] / p[0])

    assert all(len(pairs[y]) for y in (0, 1))
    for _, t in DOCS[:45] + DOCS[60:64]:
        w = read(t)
        got = model.ratio(toxicity.Reading([(t or "").encode()])) if w else np.zeros(0)
        assert np.allclose(got, [ratio(w[i - 1] if i else 0, w[i]) for i in range(len(w))], atol=1e-9)


def _brute_measures(t):
    t = t or ""
    w = re.findall(WS, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_rules(docs, labels):
    rows = rules.report(docs, labels).collect()
    got = _by(tuple(r)[:7] for r in rows)
    assert got == _by((d, *_brute_measures(t)) for d, t in DOCS)
    assert all(r["kept"] == (not r["base_failed"] and r["probability"] >= rules.KEEP) for r in rows)


def test_quality_verdict_matches_brute_force(docs, labels):
    """The model's probability again, n-gram by n-gram in Python."""
    model = rules.train(docs, labels)
    shift, slots = 64 - rules.HASH_BITS, 1 << rules.HASH_BITS
    one = lambda x: int(common.mix(np.array([x & ((1 << 64) - 1)], np.uint64))[0])

    def probability(t):
        raw = (t or "").encode()
        hashes = [int(common.hash_ranges(np.frombuffer(w, np.uint8), np.array([len(w)]))[0]) for w in raw.split()]
        text = raw.decode()
        kinds = [
            [h >> shift for h in hashes],
            [slots + (one(a * int(rules._ODD[0]) + b * int(rules._ODD[1])) >> shift) for a, b in zip(hashes, hashes[1:])],
            [2 * slots + (one(ord(a) | ord(b) << 21 | ord(c) << 42) >> shift) for a, b, c in zip(text, text[1:], text[2:])],
        ]
        z = model.bias + sum(np.mean(model.weights[k]) for k in kinds if k)
        return 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))

    got = {r["doc_id"]: r["probability"] for r in rules.score(docs.filter("doc_id > 3"), model).collect()}
    assert got and all(got[d] == pytest.approx(probability(t), abs=1e-5) for d, t in DOCS if d is not None and d > 3)


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(k, "x" * (10_000 if k % 10 == 1 else 100)) for k in range(1000)]
    lab = spark.createDataFrame([(k, 1, 0) for k in range(1000)], "doc_id long, quality int, toxic int")
    got = common.labelled_sample(_frame(spark, rows), lab, "quality", 500, most_bytes=64_000).collect()
    assert len(got) < 500 and sum(len(r["text"]) for r in got) <= 64_000 and sum(len(r["text"]) == 100 for r in got) > 400


def test_ids_of_any_type(spark, labels):
    """Operators that number rows or sample by id take ids that are no numbers; "1" and "01" are two."""
    rows = [("1", DOCS[3][1]), ("01", DOCS[3][1]), ("x", DOCS[50][1]), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    some = labels.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    ids = sorted(str(d) for d, _ in rows)
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    for got in (suffix_dedup.report(frame), rules.report(frame, some), toxicity.report(frame, some), lm.report(frame), decontam.report(frame, bench), simhash.report(frame), packing.report(frame), quality.report(frame, some)):
        assert sorted({str(r["doc_id"]) for r in got.collect()}) == ids
    assert len(near_copies.representatives(frame).collect()) == 3


@pytest.mark.parametrize("name, column, least", [("op2_quality", "quality", 0.9), ("op5_toxicity", "toxic", 0.86)])
def test_held_out_accuracy(spark, name, column, least):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).filter("held_out").join(common.table(spark, sf, "labels"), "doc_id").select("predicted", column).collect()
    assert len(got) > 500 and np.mean([r[0] == r[1] for r in got]) > least


# --- 3 ----------------------------------------------------------------------------------------------------------


def test_url_lists(spark):
    log = spark.createDataFrame(
        [("domain", "b.org", "block", "add", "2024-01-10"), ("domain", "b.org", "block", "remove", "2024-02-01"), ("domain", "a.b.org", "allow", "add", "2024-01-20"), ("word", "win", "block", "add", "2024-03-01"), ("domain", None, "block", "add", "2024-01-01")],
        "kind string, pattern string, verdict string, action string, day string",
    ).withColumn("day", url_lists.F.to_date("day"))
    urls = [(1, "http://x.b.org/p", "2024-01-09"), (2, "http://x.b.org/p", "2024-01-10"), (3, "HTTPS://u@A.B.org:80/", "2024-01-25"), (4, "http://x.b.org", "2024-02-01"), (5, "http://big-win.com/", "2024-03-01"), (6, None, "2024-01-25"), (7, "nonsense", "2024-01-25"), (8, "http://b.org/", None), (2, "http://x.b.org/p", "2024-01-10")]
    caps = spark.createDataFrame(urls, "page_id long, url string, day string").select("page_id", "url", url_lists.F.to_date("day").alias("fetched_on"))
    got = _by((r["page_id"], r["n_active"], r["decision"]) for r in url_lists.evaluate(caps, log).collect())
    assert got == _by([(1, 0, "none"), (2, 1, "block"), (2, 1, "block"), (3, 2, "allow"), (4, 0, "none"), (5, 1, "block"), (6, 0, "none"), (7, 0, "none"), (8, 0, "none")])


@pytest.mark.parametrize("small", [url_lists.SMALL_LIST, 0])
def test_url_lists_case_ties_and_long_lists(spark, monkeypatch, small):
    """Patterns are one whatever their case; with no small list, keys meet it in a shuffled join; other columns may clash."""
    monkeypatch.setattr(url_lists, "SMALL_LIST", small)
    rows = [("domain", "B.org", "block", "add", "2024-01-10"), ("domain", "b.org", "block", "remove", "2024-02-01"), ("path", "a.com/x", "block", "add", "2024-01-01"), ("path", "a.com/y", "allow", "add", "2024-01-01"), ("domain", "a.com", "block", "add", "2024-01-01")]
    rows += [("domain", f"h{k}.net", "block", "add", "2024-01-01") for k in range(300)]
    log = spark.createDataFrame(rows, "kind string, pattern string, verdict string, action string, day string").withColumn("day", url_lists.F.to_date("day"))
    deep = ".".join(["d"] * 1500)
    urls = [("p", "http://b.org/", "2024-01-31"), ("q", "http://b.org/", "2024-02-01"), ("r", "http://a.com/x/1", "2024-03-01"), ("s", "http://a.com/y?x", "2024-03-01"), ("t", f"http://{deep}.h7.net", "2024-03-01"), (None, "http://h8.net", "2024-03-01")]
    caps = spark.createDataFrame([(*u, "k", 5) for u in urls], "page_id string, url string, day string, kind string, rid int").withColumn("fetched_on", url_lists.F.to_date("day"))
    got = {r["page_id"]: (r["n_active"], r["pattern"], r["decision"]) for r in url_lists.evaluate(caps, log).collect()}
    assert got == {"p": (1, "b.org", "block"), "q": (0, None, "none"), "r": (2, "a.com/x", "block"), "s": (2, "a.com/y", "allow"), "t": (1, "h7.net", "block"), None: (1, "h8.net", "block")}


def test_url_lists_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    want = con.sql(queries.ORACLE_SQL["op3_url_lists"])
    cols = list(want.columns)
    got = queries.QUERIES["op3_url_lists"](spark, "/root/testdata/sf0.01").select(*cols).collect()
    assert _by(tuple(r) for r in got) == _by(want.fetchall())


# --- 4 ----------------------------------------------------------------------------------------------------------


def test_language_model(docs):
    tokens = lambda t: [*re.findall(WS, _lower(t)), "\0end"]
    fold = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    c = Counter(w for d, t in DOCS if not fold(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = _by((d, fold(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in DOCS)
    rows = lm.report(docs).collect()
    assert _by((*tuple(r)[:5], round(r["base_score"], 6)) for r in rows) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_scores_match_brute_force(docs):
    """Each text's score again, token by token, from the parameters with the normaliser summed over all symbols."""
    rows = common.keyed(docs)
    vocab, _ = lm.vocabulary(lm.counts(rows))
    model = lm.fit(rows, vocab)
    word, target, place, bias = (x.astype(float) for x in model.parts())
    assert model.seen == vocab.n
    got = _by((r["doc_id"], r["n_tokens"], round(r["score"], 2)) for r in lm.report(docs).collect())
    want = []
    for d, t in DOCS:
        tok = lm.Tokens([(t or "").encode()])
        c, s, classed = vocab.look_up(tok)
        total, x, y = 0.0, vocab.end, vocab.end
        for k in range(len(s)):
            z = target @ (word[x] @ place[0] + word[y] @ place[1]) + bias
            p = np.exp(z - z.max())
            total += np.log10(p[s[k]] / p.sum())
            if classed[k]:
                total += np.log10(max(c[k], 0) + 1) - np.log10(vocab.class_n[s[k]] + vocab.class_v[s[k]] + 1)
            x, y = y, s[k]
        want.append((d, len(s), round(total, 2)))
    key = lambda rows: sorted((str(a), b, c) for a, b, c in rows)
    assert all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.02 + 1e-4 * abs(b[2])) for a, b in zip(key(got), key(want), strict=True))


def test_rounds_and_trainers_follow_the_corpus():
    for n in (0, 1, 10**6, 10**9, 10**13):
        rounds, trainers = lm.schedule(n)
        assert lm.ROUNDS <= rounds <= lm.MOST_ROUNDS and (trainers == 1 or n / rounds / trainers > lm.TASK / 2)
        assert n / rounds / trainers <= lm.TASK


def test_rare_tokens_meet_their_counts_in_the_join(docs, monkeypatch):
    whole = _by((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.report(docs).collect())
    few = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda table: few(table, most=40))
    assert _by((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.report(docs).collect()) == whole


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    unigram = np.full(20, 1 / 20)
    model = lm.LogBilinear.start(unigram)
    state = [np.full_like(p, 1e-8) for p in (model.word, model.target, model.place, model.bias)]
    for _ in range(400):
        y = rng.integers(0, 20, 512)
        model.train(rng.integers(0, 20, 512), y, (y + 1) % 20, unigram, rng, state)
    one, two, z = model.tables()
    p = np.exp(one[:, None, :] + two[None] - z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    assert np.mean([p[x, y, (y + 1) % 20] for x in range(20) for y in range(20)]) > 0.5


# --- 6 ----------------------------------------------------------------------------------------------------------


def test_model_trains_on_every_position_whatever_the_files(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    few, many = (common.keyed(docs.repartition(n, "doc_id")) for n in (1, 16))
    vocab, _ = lm.vocabulary(lm.counts(few))
    for task in (lm.TASK, 1000, vocab.n // 12):  # the middle one has more trainers than go to the driver one by one
        a, b = lm.fit(few, vocab, task=task), lm.fit(many, vocab, task=task)
        assert a.seen == b.seen == vocab.n > 100_000
        assert np.allclose(a.flat(), b.flat(), atol=1e-4)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in DOCS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            own = ids[start : start + (2048 if k else first)]
            want.append((d, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = packing.report(docs).collect()
    assert _by(tuple(r)[:5] for r in rows) == _by(want)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_plan_uses_every_piece_and_keeps_optimality():
    rng = random.Random(5)
    for _ in range(100):
        cap = rng.choice([10, 100, 2048])
        count = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 200)))
        used = Counter()
        for lengths, times in packing.plan(count, cap):
            assert sum(lengths) <= cap
            for x in lengths:
                used[x] += times
        assert used == count
    fixed, rest = packing.reduce({9: 2, 6: 3, 4: 5, 1: 1}, 10)
    assert ((9, 1), 1) in fixed and ((6, 4), 3) in fixed


def _fewest(items, cap):
    """Exhaustive search."""
    items, best, bins = sorted(items, reverse=True), [len(items)], []

    def go(i):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= cap}.values():
            bins[k] += items[i]
            go(i + 1)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1)
        bins.pop()

    go(0)
    return best[0]


def test_dominance_is_part_of_an_optimal_packing():
    rng, triples = random.Random(1), 0
    for _ in range(600):
        cap = rng.choice([10, 20, 30, 100])
        low = rng.choice([1, cap // 6 + 1, cap // 4, cap // 3])
        items = [rng.randint(low, rng.choice([cap, cap * 2 // 3, cap // 2 + 1])) for _ in range(rng.randint(1, 10))]
        fixed, rest = packing.reduce(Counter(items), cap)
        triples += sum(len(x) == 3 for x, _ in fixed)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + _fewest(left, cap) == _fewest(items, cap), items
    assert triples > 50


def test_the_plan_does_not_grow_with_the_pieces():
    rng = random.Random(2)
    for count in ({1500: 160_000, 500: 160_000}, {k: rng.randint(1, 10**7) for k in range(1, 2049)}, {k: rng.randint(1, 10**7) for k in range(600, 1400)}):
        got = packing.plan(count)
        used = Counter()
        for lengths, times in got:
            for x in lengths:
                used[x] += times
        assert used == count and len(got) < 3 * 2048
        assert sum(n for _, n in got) < 1.03 * sum(k * n for k, n in count.items()) / 2048


def test_pieces_join_to_the_tokens(unique):
    rows = packing.pack(unique, with_ids=True).collect()
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


# --- 7 ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    import base64

    html = ["<p>ä</p>", "same", "same", None, "", "x" * 300_000, "a\r\n\r\nb", "same"]
    rows = [(10 - i, f"http://h/{i}\r\nX: y" if i == 1 else None, h) for i, h in enumerate(html)] + [(None, "u", "same"), (8, "again", "same"), (None, "v", "only null"), (3, "w", "z"), (3, "w", "z")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        body, top = (h or "").encode(), first.get(h or "")
        revisit = top is not None and p != top
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert _by(tuple(r)[:5] for r in warc.report(pages).collect()) == _by(want)


@pytest.mark.parametrize("small", [warc.SMALL_TABLE, 0])
def test_warc_keeps_ids_and_urls_of_any_kind(spark, monkeypatch, small):
    """With no small table, pages meet the revisits in a shuffled join."""
    monkeypatch.setattr(warc, "SMALL_TABLE", small)
    rows = [("a/b:c>", None, "x"), ("none", "http://u/ü", "x"), (None, "", "x"), ("", "http://v", "y")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder = common.scratch(spark, "warc-test")
    got = _by((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages, folder), folder, "string").collect())
    assert got == _by([("a/b:c>", None, "response", None), ("none", "http://u/ü", "revisit", "a/b:c>"), (None, "", "revisit", "a/b:c>"), ("", "http://v", "response", None)])
    assert _by((r["page_id"], r["refers_to"]) for r in warc.report(pages).collect()) == _by((a, d) for a, _, _, d in got)


def test_warc_reads_headers_of_any_length():
    url = "http://a.example/" + "".join(map(str, range(400_000)))
    assert len(url) > 2_000_000
    got = list(warc.records(io.BytesIO(warc.encode(7, url, b"page", None) + warc.encode(8, url, b"page", 7))))
    assert [(r.page_id, r.refers_to, r.headers["warc-target-uri"] == url, r.payload_bytes) for r in got][0] == ("7", None, True, 4)
    assert got[1].page_id == "8" and got[1].refers_to == "7"


def test_warc_reader_checks_what_it_reads():
    import gzip
    import io

    good = warc.encode(1, "http://a", b"payload" * 50_000, None) + warc.encode(2, "http://a", b"payload" * 50_000, 1)
    got = list(warc.records(io.BytesIO(good)))
    assert [(r.page_id, r.refers_to, r.payload_bytes) for r in got] == [("1", None, 350_000), ("2", "1", 350_000)] and got[0].payload == b"payload" * 50_000
    plain = gzip.decompress(warc.encode(1, "http://a", b"payload", None))
    for bad in (plain.replace(b"payload\r", b"paxload\r"), plain.replace(b"Content-Length: ", b"Content-Length: 1", 1), plain[:-2]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-20])))


# --- 8 ----------------------------------------------------------------------------------------------------------


BENCH = [("1", DOCS[0][1] + " " + DOCS[1][1]), ("10", "Solo"), ("2", DOCS[50][1]), ("2", "x"), ("3", None), (None, "one line here"), ("4", "ab ab ab ab ab ab ab ab"), ("5", ""), ("6", "one LINE here")]


def _brute_hits(rows, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    wins = defaultdict(set)
    for i, t in bench:
        w = words(t)
        if i is not None and w:
            for k in range(max(len(w) - 8, 0) + 1):
                wins[tuple(w[k : k + 8])].add(str(i))
    out = []
    for d, t in rows:
        w = words(t)
        hit, items = set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if k + n <= len(w) and tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    items |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2))
    return _by(out)


@pytest.mark.parametrize("limit", [decontam.BENCH_BYTES, 300])
def test_decontamination(spark, docs, monkeypatch, limit):
    """With the small limit the benchmark comes in several blocks."""
    monkeypatch.setattr(decontam.search, "__defaults__", (limit,))
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    assert _by(tuple(r) for r in decontam.report(docs, bench).collect()) == _brute_hits(DOCS, BENCH)


def _brute_clean(rows, bench):
    """The texts that stay: stretches of hit words are cut, from the first one's start to the last one's end."""
    out = []
    for d, t in rows:
        (_, _, n_hit, n_items, _, _), = _brute_hits([(d, t)], bench)
        if n_items >= 2:
            continue
        if n_hit:
            found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))]
            words = [_lower(t)[a:b] for a, b in found]
            wins = {tuple(w[k : k + 8]) for i, x in bench if i is not None and x for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(x))] if w for k in range(max(len(w) - 8, 0) + 1)}
            hit = {j for k in range(len(words)) for w in wins if tuple(words[k : k + len(w)]) == w for j in range(k, k + len(w))}
            left, at = "", 0
            for k in sorted(hit):
                if k - 1 not in hit:
                    left += t[at : found[k][0]]
                at = found[k][1]
            t = left + t[at:]
        out.append((d, t))
    return _by(out)


@pytest.mark.parametrize("limit", [decontam.BENCH_BYTES, 300, 1])
def test_cleaning_is_the_same_in_any_blocks(spark, docs, limit):
    """Null and repeated ids too; an item in two blocks is one item, and adjoining windows of two blocks are one passage."""
    words = [f"b{k}" for k in range(16)]
    rows = [(100, "s " + " ".join(words) + " e"), (100, "clean text of the same id"), (None, "s " + " ".join(words[:8]) + " e"), (101, " ".join(words[8:]) + "\n" + BENCH[0][1]), (None, None)]
    bench = [*BENCH, ("7", " ".join(words[:8])), ("7", " ".join(words[8:]))]
    got = decontam.clean(docs.unionByName(_frame(spark, rows)), spark.createDataFrame(bench, "item_id string, text string"), limit)
    assert got.columns == docs.columns
    left = got.collect()
    assert _by((r["doc_id"], r["text"]) for r in left) == _brute_clean(DOCS + rows, bench)
    assert "s  e" in {r["text"] for r in left} and all(r["n_chars"] == len(r["text"] or "") for r in left)


def test_sampled_positions_locate_every_occurrence():
    rng = np.random.default_rng(4)
    runs = np.concatenate([np.append(rng.integers(1, 5, rng.integers(1, 40)), 0) for _ in range(60)]).astype(np.int32)
    index = decontam.FmIndex(runs, 4, 8)
    assert len(index.place) < len(runs) / 3
    pattern = np.array([[0, 2, 3]])
    low, high = index.search(pattern, np.array([2]))
    want = [i for i in range(len(runs) - 1) if runs[i] == 2 and runs[i + 1] == 3]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_decontamination_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in common.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert _by(tuple(r) for r in queries.QUERIES["op8_decontaminate"](spark, sf).collect()) == _brute_hits(rows, bench)


# --- 9 ----------------------------------------------------------------------------------------------------------


def _fingerprint(t):
    w = re.findall(WS, _lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    flat = list(root)
    for i, a in enumerate(flat):
        for b in flat[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in flat}


def test_simhash(docs):
    fps = [(d, _fingerprint(t)) for d, t in DOCS]
    root = _brute_components({f for _, f in fps})
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    got = _by(tuple(r) for r in simhash.report(docs).collect())
    assert got == _by((d, f"{f:016x}", least.get(root[f])) for d, f in fps)


def test_links_keep_dense_and_chained_clusters_together(spark):
    rng = random.Random(11)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ (1 << a) ^ (1 << b) for a in rng.sample(range(64), 12) for b in rng.sample(range(64), 12)}
        chain = rng.getrandbits(64)
        for k in range(40):
            fps.add(chain)
            chain ^= 3 << (k % 62)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    dense = rng.getrandbits(64)
    fps |= {dense ^ k for k in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(edges).collect()}
    want = _brute_components(fps)
    groups = lambda m: sorted(tuple(sorted(g)) for g in _invert(m).values() if len(g) > 1)
    assert groups({f: got.get(f, f) for f in fps}) == groups(want)
    assert edges.count() < 28 * len(fps)


def _invert(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out


def test_one_row_of_each_group_stays(unique):
    kept = {r["doc_id"] for r in simhash.representatives(unique).collect()}
    comp = {r["doc_id"]: r["component_id"] for r in simhash.report(unique).collect()}
    assert kept == set(comp.values())


# --- all --------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], SCHEMA)
    no_labels = labels.filter("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    for df in (
        suffix_dedup.report(none), suffix_dedup.cut(none), quality.report(none, no_labels), url_lists.report(pages), lm.report(none), toxicity.report(none, no_labels), packing.report(none),
        warc.report(pages), decontam.report(none, bench), decontam.clean(none, bench), simhash.report(none), simhash.representatives(none), rules.report(none, no_labels),
    ):
        assert df.collect() == []
    one = _frame(spark, [(1, "some words here")])
    assert quality.report(one, no_labels).count() == toxicity.report(one, no_labels).count() == rules.report(one, no_labels).count() == decontam.report(one, bench.filter("false")).count() == 1


def test_every_operator_is_registered():
    assert {re.match(r"op\d+", n)[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert os.path.isdir("/root/testdata/sf0.001") and glob.glob("/root/testdata/sf0.001/*.parquet")
