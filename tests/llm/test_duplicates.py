"""Duplicate operators and the pipeline, against plain Python over whole small tables."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from streamgraph.llm import components, decontaminate, idsets, near_dedup, quality, repeats, scratch, words

from ..conftest import DATA
from .test_filters import DOCS, LOWER, ODD, SPACED, brute_contamination, documents, whole


def tokens(text):
    return SPACED.findall((text or "").translate(LOWER))


def brute_components(docs):
    sets = {}
    for doc, text in docs:
        w = tokens(text)
        sets[doc] = set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d), d == find(d)) for d in ids}


def copies(rng, n, edits):
    base = [f"b{i}" for i in range(120)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [128, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(block)
    texts = [*ODD, *copies(rng, 90, [0, 1, 2, 3, 4, 5, 6, 9]), "a b c d", "A b  c d", "a b c", "x"]
    docs = documents(spark, texts)
    got = near_dedup.near_duplicates(docs)
    assert {tuple(r) for r in got.where("doc_id is not null").collect()} == brute_components(enumerate(texts))
    assert got.where("doc_id is null and kept and component_id is null").count() == 1
    assert near_dedup.near_duplicates(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("bits", [64, idsets.MOST])
def test_texts_of(spark, monkeypatch, bits):
    monkeypatch.setattr(idsets, "MOST", bits)
    docs = spark.createDataFrame([(k, f"t{k}", 0) for k in range(300)] + [(7, "t7", 1), (None, "x", 2)], "doc_id int, text string, word int")
    ids = spark.createDataFrame([(k,) for k in [*range(0, 300, 3), 7, 7, 999]], "doc_id bigint")
    assert sorted(map(tuple, near_dedup.texts_of(docs, ids).collect())) == sorted((k, f"t{k}") for k in {*range(0, 300, 3), 7})
    assert near_dedup.texts_of(docs, ids.limit(0)).isEmpty()
    left = idsets.without(docs, ids.distinct())
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] is None or r["doc_id"] % 3 and r["doc_id"] != 7)


def test_near_duplicates_of_the_table(spark):
    docs = whole(spark)
    assert {tuple(r) for r in near_dedup.near_duplicates(docs).collect()} == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for size in (1, 3, 60, 2000):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = np.r_[a[: size * 3 // 4], rng.integers(0, 2**63, size - size * 3 // 4, dtype=np.uint64)]
        s = near_dedup.sketches(np.r_[a, b], np.array([0, size, 2 * size]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert s.shape == (2, 128) and abs((s[0] == s[1]).mean() - true) < 0.2
    assert np.array_equal(near_dedup.sketches(np.r_[a, a], np.array([0, size, 2 * size]))[0], near_dedup.sketches(a, np.array([0, size]))[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101)] + [(200, i) for i in range(201, 260)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((100, 101, 103), 100) | dict.fromkeys(range(200, 260), 200)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def brute_repeats(docs, length=50):
    seen, out = {}, set()
    for doc, text in sorted(docs):
        w = tokens(text)
        for k in range(len(w) - length + 1):
            window = tuple(w[k : k + length])
            if window in seen:
                out |= {(doc, j) for j in range(k, k + length)}
            else:
                seen[window] = doc
    return out


def covered(rows):
    return {(r["doc_id"], j) for r in rows for j in range(r["start"], r["start"] + r["n_words"])}


def test_minimisers_are_the_leftmost_minima():
    value = np.random.default_rng(2).integers(0, 20, 500).astype(np.uint64)
    for span in (1, 2, 3, 7, 43):
        want = [i + int(np.argmin(value[i : i + span])) for i in range(500 - span)]
        assert repeats.leftmost_minima(value, span)[: 500 - span].tolist() == want


def test_repeated_spans(spark):
    docs = whole(spark)
    want = brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert want and covered(repeats.repeated_spans(docs).collect()) == want
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join([*(f"u{n}x{i}" for i in range(rng.randrange(40))), *passage[rng.randrange(30) : 60 + rng.randrange(30)], *(f"v{n}x{i}" for i in range(rng.randrange(40)))]) for n in range(30)]
    texts += [*ODD, *copies(rng, 20, [0, 1, 2]), "z " * 200, "s t " * 60]
    docs = documents(spark, texts)
    rows = repeats.repeated_spans(docs).collect()
    assert covered(rows) == brute_repeats(enumerate(texts)) and all(r["source_doc_id"] <= r["doc_id"] for r in rows)
    assert repeats.repeated_spans(docs.limit(0)).isEmpty()


def test_repeated_spans_of_one_passage_everywhere(spark):
    """A passage of which every document holds another part, with other words on both sides, in many small ranges and batches."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for n in range(120):
        a = rng.randrange(70)
        texts.append(" ".join([*(f"l{n}x{i}" for i in range(rng.randrange(3))), *passage[a : a + 50 + rng.randrange(70 - a + 1)], *(f"r{n % 5}x{i}" for i in range(rng.randrange(60)))]))
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute_repeats([(1000 - i, t) for i, t in enumerate(texts)])
    for rows in (10_000, 3):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert covered(repeats.repeated_spans(docs).collect()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_that_repeat_an_id_are_cut_each_by_its_own_spans(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    made = [(1, f"{a} z0 z1 another document", 5, "keep"), (1, "short text", 5, "keep"), (1, "short text", 6, "keep"), (2, f"x {b} y", 5, "keep"), (2, f"u {a} v", 5, "keep"), (3, f"{b} w", 5, "keep"), (None, a, 5, "keep"), (4, None, 5, "keep")]
    docs = spark.createDataFrame(made, "doc_id int, text string, _spans int, copy string").coalesce(1)
    got = sorted((str(r["doc_id"]), " ".join((r["text"] or "").split()), r["_spans"], r["copy"]) for r in repeats.without_repeats(docs).collect())
    texts = [("1", made[0][1], 5), ("1", "short text", 5), ("1", "short text", 6), ("2", "u v", 5), ("2", made[3][1], 5), ("3", "w", 5), ("None", a, 5), ("4", "", 5)]
    assert got == sorted((i, t, n, "keep") for i, t, n in texts)
    assert repeats.without_repeats(docs).columns == docs.columns and repeats.without_repeats(docs.limit(0)).isEmpty()


def test_texts_without_repeats(spark):
    a = " ".join(f"a{i}" for i in range(60))
    texts = [f"start {a} end", f"other\n{a}\n  tail é", a, None, ""]
    rows = spark.createDataFrame([(i, t, None, None, len(t or ""), None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in repeats.without_repeats(rows).collect()}
    assert got.keys() == {0, 1, 3, 4} and got[0]["text"] == texts[0] and got[1]["text"].split() == ["other", "tail", "é"] and got[1]["n_chars"] == len(got[1]["text"])
    assert repeats.without_repeats(rows).columns == rows.columns


def test_words_equal_the_patterns():
    texts = [t or "" for t in ODD] + ["", "é", "a", ""]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    w = words.words_of(batch, words.SPACED)
    data = w.data.tobytes()
    found = [[data[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first, w.first[1:], strict=False)]
    assert found == [SPACED.findall(t) for t in texts]
    by_hash = collections.defaultdict(set)
    for h, a, b in zip(w.hash.tolist(), w.start, w.end, strict=True):
        by_hash[h].add(data[a:b].lower())
    assert all(len(x) == 1 for x in by_hash.values()) and len({x for s in by_hash.values() for x in s}) == len(by_hash)


def test_pipeline_stages_against_brute_force(spark):
    docs = whole(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = stages["quality rules"](spark, docs, DATA)
    kept = rows(one)
    assert kept.keys() == {r["doc_id"] for r in quality.verdicts(docs, whole(spark, "labels")).where("kept").collect()}
    source = spark.createDataFrame([r for r in docs.collect() if r["doc_id"] in kept], docs.schema)
    two = stages["MinHash near-dedup"](spark, source, DATA)
    left = rows(two)
    assert left.keys() == {d for d, _, _, k in brute_components(kept.items()) if k}
    source = spark.createDataFrame([r for r in docs.collect() if r["doc_id"] in left], docs.schema)
    three = stages["suffix-array dedup"](spark, source, DATA)
    cut = rows(three)
    gone = collections.Counter(d for d, _ in brute_repeats(left.items()))
    assert {d: len(tokens(t)) for d, t in cut.items()} == {d: n for d, t in left.items() if (n := len(tokens(t)) - gone[d])}
    assert three.columns == docs.columns
    source = spark.createDataFrame([(*r,) for r in three.collect()], docs.schema)
    four = rows(stages["benchmark decontamination"](spark, source, DATA))
    bench = [(r["item_id"], r["text"]) for r in whole(spark, "benchmark").collect()]
    assert four.keys() == {r[0] for r in brute_contamination(cut.items(), bench) if not r[5]}
    final = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in final} == four.keys()


def odd_table(spark):
    """Null ids and texts, empty and long texts, repeated rows and ids, ties, and columns that clash with helpers."""
    rng = random.Random(11)
    prose = [" ".join(f"w{n}x{i}" for i in range(80)) for n in range(8)]
    texts = [*ODD, *prose, *prose[:3], " ".join(copies(rng, 1, [0])), "long " + " ".join(f"q{i}" for i in range(30_000))]
    rows = [(i, t, "en", "s", len(t or ""), "flag", i, "w") for i, t in enumerate(texts)]
    rows += [(None, prose[0], None, None, None, None, None, None), (None, prose[0], None, None, None, None, None, None), rows[14], (15, prose[7], "", "s", 1, "x", 1, "w")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _flag string, _word bigint, _t string")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, name):
    docs = odd_table(spark)
    for t in ("labels", "benchmark"):
        whole(spark, t).limit(0 if name == "quality rules" else 1000).write.parquet(f"{tmp_path}/{t}.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path) + "/").isEmpty() if name != "packing" else True
    rows = out.collect()
    if name == "packing":
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if not r["start"]) == sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect())
        return
    assert out.columns == docs.columns
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["_word"]))
    got, had = sorted(map(key, rows)), sorted(map(key, docs.collect()))
    if name == "quality rules":
        kept = {r["doc_id"] for r in quality.verdicts(docs, whole(spark, "labels").limit(0)).where("kept").collect()}
        assert got == [k for k in had if (None if k[0] == "None" else int(k[0])) in kept]
    elif name == "MinHash near-dedup":
        ids = [k[0] for k in got]
        assert ids.count("None") == 2 and set(got) <= set(had) and all(n == 1 for k, n in collections.Counter(got).items() if k[0] != "None")
        assert "20" not in ids and "21" not in ids and "13" in ids  # copies of 13 and 14
    elif name == "suffix-array dedup":
        assert set(k for k in had if k[0] == "None") <= set(got) and len(got) < len(had)
    else:
        assert got == had


def test_tables_of_a_run_go_alone(spark):
    one, other = scratch.run(spark), scratch.run(spark)
    with one:
        a = scratch.keep(spark.range(3), "a")
    with other:
        b = scratch.keep(spark.range(4), "b")
    c = scratch.keep(spark.range(5), "c")
    one.close()
    assert (b.count(), c.count()) == (4, 5)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        a.collect()


def test_a_frame_survives_a_pipeline_run(spark):
    docs = whole(spark).limit(40)
    lazy = quality.verdicts(docs, whole(spark, "labels"))
    assert corpus_pipeline.run(spark, DATA).count() and lazy.count() == 40


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "local-cluster[3,2,1024]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(Fake)


def test_strays_send_sketches_before_sets(spark, monkeypatch):
    """Members of one bucket that resemble nothing are never read again: no set of theirs is made."""
    n = 600
    rng = np.random.default_rng(5)
    made = []
    monkeypatch.setattr(near_dedup, "texts_of", lambda docs, ids: made.append(ids.distinct().count()) or docs.select("doc_id", "text").join(ids.distinct(), "doc_id"))
    w = [" ".join(f"t{i}x{j}" for j in range(30)) for i in range(n)]
    w[7] = w[3] + " more words here"
    docs = spark.createDataFrame(list(enumerate(w)), "doc_id bigint, text string")
    sketch = rng.integers(0, 2**32, (n, near_dedup.BINS), dtype=np.uint32)
    sketch[7, :100] = sketch[3, :100]
    nodes = spark.createDataFrame([(i, 26 + 3 * (i == 7), bytearray(sketch[i].tobytes())) for i in range(n)], "doc_id bigint, n bigint, sketch binary")
    buckets = spark.createDataFrame([(1, i, 26 + 3 * (i == 7)) for i in range(n)], "key bigint, doc_id bigint, n bigint")
    leaders = spark.createDataFrame([(1, 0)], "key bigint, leader bigint")
    labels = spark.createDataFrame([], "id bigint, component bigint")
    got = near_dedup.leftover(buckets, leaders, labels, nodes, docs)
    assert [tuple(r) for r in got.collect()] == [(3, 7)] and made == [2]


def test_nothing_here_is_imported_from_outside():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "streamgraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.MULTILINE), p
    assert decontaminate.WINDOW == 13
