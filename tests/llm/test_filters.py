"""Operators that judge or transform single rows, against plain Python over whole small tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from math import comb

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamgraph.llm import bpe, chat, decontaminate, html, language, licences, packing, quality, queries, token_counts, words

from ..conftest import DATA

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "a", "a b c a b c", "x\x0by\x85z", "é É ß\nfoo\nfoo", "# $ | <>", "日本 語 🙂", "<|endoftext|> a <|endoftext|>", "A" * 5000, "w " * 3000]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, stratum string, id bigint"


def documents(spark, texts=ODD):
    """Texts with a null id, repeated rows and columns whose names clash."""
    rows = [(i, t, "en", None, len(t or ""), "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id " * 60, None, None, None, None, None), *rows[:3]], DOCS)


def whole(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def repeated(text):
    w = SPACED.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("real", [True, False])
def test_quality_base_columns(spark, real):
    docs = whole(spark) if real else documents(spark)
    for r in quality.base(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == repeated(r["text"] or "")
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 50, 0.02), (7, 800, 0.01), (40, 5000, 0.01), (0, 1, 0.5), (5, 5, 0.3)])
def test_binomial_tail_is_exact(spark, k, n, p):
    want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p).alias("x")).first()["x"]
    assert got == pytest.approx(want, rel=1e-9)


def test_quality_thresholds_keep_the_good_and_reject_the_bad(spark):
    good = ["word%d other%d thing%d, " % (i, i + 1, i + 2) * 1 + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(800)]
    bad = ["## $$ " + " ".join(f"w{i}#{j}***" for j in range(60)) for i in range(40)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 800), 0) for i in range(840)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).where("doc_id is not null").collect()}
    assert all(judged[i]["kept"] for i in range(800)) and not any(judged[i]["kept"] for i in range(800, 840))
    assert judged[0]["n_chars"] == len(good[0]) and "symbol_share" in judged[801]["failed_signals"]
    assert quality.verdicts(docs, labels.limit(0)).where("kept").count() > 0  # nothing is proven without labels
    assert quality.judge(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("pooled", [True, False])
def test_quality_small_strata_borrow_cutoffs(spark, pooled):
    """Two strata of 400 good labels prove a cutoff together only; one of 100 and one without labels take what the large one proves."""
    good = lambda i: f"number{i} " + " ".join(f"w{i}x{j}" for j in range(60))
    shout = lambda i: f"number{i} " + " ".join(f"W{i}X{j}" for j in range(60))
    bad = lambda i: "## $$ " + " ".join(f"w{i}#{j}***" for j in range(60))
    sizes = {"de": 400, "fr": 400} if pooled else {"en": 800, "de": 100}
    rows = [(lang, good(i), 1) for lang, n in sizes.items() for i in range(n - 10)] + [(lang, shout(i) if lang == "de" else good(i + 9000), 1) for lang in sizes for i in range(10)]
    rows += [(lang, bad(i), 0) for lang in [*sizes, "it"] for i in range(20)] + [("it", good(i), None) for i in range(20)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t, _) in enumerate(rows)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (lang, _, q) in enumerate(rows) if lang != "it"], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs, labels).collect()}
    assert all(kept[i] == (q != 0) for i, (_, _, q) in enumerate(rows))  # capitals are good in de by its own labels


def windows_of(text, k=13):
    w = ALNUM.findall((text or "").translate(LOWER))
    return w, [tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)] if w else []


def brute_contamination(docs, items):
    by_window = collections.defaultdict(set)
    for item, text in items:
        for x in windows_of(text)[1]:
            by_window[x].add(item)
    sizes = {len(x) for x in by_window}
    for doc, text in docs:
        w, hit, found = windows_of(text)[0], set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in by_window:
                    hit |= set(range(i, i + n))
                    found |= by_window[x]
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    benchmark = [(r["item_id"], r["text"]) for r in whole(spark, "benchmark").collect()]
    got = sorted(map(tuple, queries.op4_decontaminate(spark, DATA).collect()))
    assert got == sorted(brute_contamination([(r["doc_id"], r["text"]) for r in whole(spark).collect()], benchmark)) and any(r[5] for r in got)
    rng = random.Random(1)
    vocabulary = "a b c dé".split()
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([1, 2, 3, 5, 13, 14, 30])] + [(7, None), (8, "!!"), (9, "a B")]
    texts = [make(n) for n in (0, 1, 2, 12, 13, 40, 3000)] + ODD
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs, bench).where("doc_id is not null").drop("matches").distinct().collect()
    assert sorted(map(tuple, got)) == sorted(brute_contamination(list(enumerate(texts)), items))
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty() and decontaminate.contamination(docs.limit(0), bench).isEmpty()


def test_long_benchmarks_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    benchmark = [(r["item_id"], r["text"]) for r in whole(spark, "benchmark").collect()]
    got = decontaminate.contamination(whole(spark), whole(spark, "benchmark")).drop("matches").collect()
    assert sorted(map(tuple, got)) == sorted(brute_contamination([(r["doc_id"], r["text"]) for r in whole(spark).collect()], benchmark))


def brute_matches(text, items, k=13):
    """Maximal matches on every diagonal, of those the ones that no other match of the item covers."""
    w = windows_of(text)[0]
    for item, other in items:
        v = windows_of(other)[0]
        least, runs = min(k, len(v)), set()
        for a in range(len(w)):
            for b in range(len(v)):
                if a and b and w[a - 1] == v[b - 1]:
                    continue
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                if n >= least > 0:
                    runs.add((a, n, b))
        yield from ((str(item), *r) for r in runs)


def test_matches_are_the_longest_verbatim_ones(spark, monkeypatch):
    """Two passages of an item that touch in a document are two matches."""
    v = [f"v{i}" for i in range(60)]
    items = [(5, " ".join(v)), (12, "x y z"), (7, " ".join(v[30:50]))]
    texts = [" ".join(v[:13] + v[20:40]), "a x y z b x y z", " ".join(["q", *v, "r"]), " ".join(v[:12]), None]
    docs = documents(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"])
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = {i: sorted(brute_matches(t, items)) for i, t in enumerate(texts)}
    assert {("5", 0, 13, 0), ("5", 13, 20, 20), ("7", 23, 10, 0)} - set(want[0]) == {("7", 23, 10, 0)}
    for limit in (decontaminate.BLOCK_BYTES, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = {r["doc_id"]: sorted(map(tuple, r["matches"])) for r in decontaminate.contamination(docs, bench).collect()}
        assert got == want
        left = decontaminate.clean(docs, bench)
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {3, 4}


def test_matches_in_repetition_stay_few():
    test = decontaminate.Suffixes(["1"], ["w " * 3000], 13)
    w = words.words_of(pa.RecordBatch.from_pydict({"text": ["w " * 4000]}), words.ALNUM)
    found = decontaminate.matches_of(w, test)[0]
    assert found[0] == {"item_id": "1", "start": 0, "length": 3000, "item_start": 0} and len(found) < 4 and max(m["start"] + m["length"] for m in found) == 4000


def test_a_task_builds_its_suffixes_once(monkeypatch):
    built = []
    monkeypatch.setattr(decontaminate, "Suffixes", lambda *x: built.append(1) or type("None_", (), {"seeds": []})())
    monkeypatch.setattr(decontaminate, "matches_of", lambda w, test: {})
    frames = []
    fake = type("Frame", (), {"mapInArrow": lambda self, f, schema: frames.append(f), "sparkSession": type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda b: type("B", (), {"value": b}))})})})()
    decontaminate._searched(fake, (["1"], ["a"]), 13, lambda part, w, m: part, "")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a" * (2 << 20), "b"]})
    assert len(list(frames[0](iter([batch, batch, batch])))) == 6 and built == [1]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer())


def test_ids_equal_the_library(library):
    enc = bpe.Bpe(queries.tokenizer())
    spaces = " \n\t\x0b\x1c\x85\xa0"
    texts = [t or "" for t in ODD] + [f"{c}a{c} {c} b{c}1{c}" for c in map(chr, range(1, 0x250))] + [f"a{x}{y}b {x}" for x in spaces for y in spaces] + ["it's  we'll ", "ab ­cd", "Ω ≈ ç 한국어"]
    for text in texts:
        assert enc.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_are_cut_at_safe_boundaries(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 7)
    enc, rng = bpe.Bpe(queries.tokenizer()), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", " ", "  ", "\n", "'s", "1", "é", "!", "\xa0", "word "]) for _ in range(40))
        assert enc.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(list(enc.chunks(text))) >= 1


def test_token_counts(spark, library):
    for docs in (whole(spark), documents(spark)):
        texts = [r["text"] or "" for r in docs.collect()]
        got = token_counts.token_counts(docs, queries.tokenizer()).collect()
        counts = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len(t.encode()), n, n > 1024) for t, n in zip(texts, counts, strict=True))
    assert token_counts.token_counts(docs.limit(0), queries.tokenizer()).isEmpty()
    pieces = token_counts.token_counts(documents(spark, ["a b", None, ""]), public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(r["n_tokens"] for r in pieces.where("doc_id is not null").distinct().collect())[:2] == [0, 0]


def packed(docs, rows, library):
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, library):
    docs = whole(spark)
    packed([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs, queries.tokenizer()).collect(), library)
    odd = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    packed([(r["doc_id"], r["text"]) for r in odd.collect()], packing.pack(odd, queries.tokenizer()).collect(), library)
    assert packing.pack(documents(spark), queries.tokenizer()).count() >= len(ODD) + 4 and packing.pack(docs.limit(0), queries.tokenizer()).isEmpty()


def test_packing_encodes_each_unit_of_a_shard_once(library, monkeypatch):
    """What is encoded is in proportion to the distinct units, and the ids are the library's."""
    rng = random.Random(4)
    names = ["".join(rng.choices("abcdeé\u0436", k=rng.randrange(2, 9))) for _ in range(200)]
    texts = [" ".join(rng.choices(names, k=300)) for _ in range(40)] + [None, ""]
    enc, sent = bpe.Bpe(queries.tokenizer()), []
    encode = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda chunk: sent.append(chunk) or encode(chunk))
    got = packing.encoded(enc, pa.array(texts), 1)
    assert [x.tolist() for x in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert sum(map(len, sent)) < sum(len(t or "") for t in texts) / 10


@pytest.mark.parametrize("broken", [None, "hashes", "sizes", "bytes", "pieces"])
def test_batches_of_texts_have_the_ids_of_single_texts(library, monkeypatch, broken):
    """White space of all kinds, special strings and long units; hashes that agree, ids of unknown size, batches beyond the limit."""
    bits = ["a", "b ", " ", "  ", "\n", "'s", "1", "\u00e9", "!", "\xa0", "word ", "\x85", "\u00e0 ", "\u2003", "\u3000", "\u6587", "\u1680", "\u200b", "\u0250 "]
    bits += ["<|endoftext|>", "<|endof", "text|>", "\u0416 \u0436", "\x1c", "\x00", "\u201c", "x" * 70 + " ", "\t", "\U0001f642", "\u180e", "\u2028 ", "\u202f"]
    enc, rng = bpe.Bpe(queries.tokenizer()), random.Random(7)
    if broken == "hashes":
        monkeypatch.setattr(words, "hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    elif broken == "sizes":
        enc.size[:] = 1
    elif broken == "bytes":
        monkeypatch.setattr(bpe, "BATCH_BYTES", 50)
    elif broken == "pieces":
        enc = bpe.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for k in range(150):
        texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(rng.randrange(1, 9))] + [None] * (k % 2)
        want = [enc.ids(t or "").tolist() if broken == "pieces" else library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in packing.encoded(enc, pa.array(texts, pa.string()), 1)] == [[*x, 1] for x in want]


def test_packing_puts_neighbours_together():
    texts = [f"{'apple pear plum' if i % 2 else 'iron steel zinc'} extra{i}" for i in range(20)]
    index = packing.Index(words.words_of(pa.RecordBatch.from_pydict({"text": texts}), words.ALNUM))
    scores = index.scores(index.words(0))
    assert scores[0] == scores.max() and min(scores[2::2]) > max(scores[1::2])
    brute = collections.Counter(w for t in texts for w in set(t.split()))
    term = lambda w: np.log1p((20 - brute[w] + 0.5) / (brute[w] + 0.5)) * 2.2 / (1 + 1.2)
    assert scores[2] == pytest.approx(sum(map(term, "iron steel zinc".split())))


def brute_order(shards, sizes, window=2048):
    """The documents in the order of the greedy rule, with BM25 word by word; then who was each one's seed."""
    used, seed, laid = 0, None, []
    for texts, lengths in zip(shards, sizes, strict=True):
        bags = [collections.Counter(ALNUM.findall(t.translate(LOWER))) for t in texts]
        n, mean = len(texts), sum(sum(b.values()) for b in bags) / len(texts)
        df = collections.Counter(w for b in bags for w in b)

        def score(query, i, bags=bags, n=n, mean=mean, df=df):
            size = sum(bags[i].values())
            return sum(np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * bags[i][w] * 2.2 / (bags[i][w] + 1.2 * (1 - 0.75 + 0.75 * size / mean)) for w in query if bags[i][w])

        left = list(range(n))
        while left:
            pick = left[0] if seed is None else max(left, key=lambda i: (round(score(seed, i), 9), -i))
            seed = set(bags[pick]) if seed is None else seed
            left.remove(pick)
            laid.append(texts[pick])
            total = used + lengths[pick]
            if total >= window:
                seed = set(bags[pick]) if total % window else None
                seed = None if total % window == 0 else seed
            used = total % window
    return laid


def test_packing_deals_copies_from_all_over_the_table_side_by_side(spark):
    draw = np.random.default_rng(1)
    names = np.array(["".join(map(chr, draw.integers(97, 123, 7))) for _ in range(6000)])
    topics = [" ".join(draw.choice(names, 300)) for _ in range(40)]
    texts = [f"{topics[i % 40]} {names[i]} {names[-i]}" for i in range(800)] + [None, "", "..."] * 5
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    dealt = packing.deal(table).withColumn("part", F.spark_partition_id())
    assert sorted((r.doc_id, r.text or "") for r in dealt.collect()) == [(i, t or "") for i, t in enumerate(texts)]
    parts = dealt.where("doc_id < 800").groupBy((F.col("doc_id") % 40).alias("topic"), "part").count().groupBy("topic").agg(F.max("count").alias("n")).collect()
    assert sorted(r.n for r in parts)[20] >= 15  # of 20 copies of a topic
    again = packing.deal(table)
    assert [r.doc_id for r in dealt.select("doc_id").collect()] == [r.doc_id for r in again.collect()]
    assert "RebalancePartitions" in again._jdf.queryExecution().optimizedPlan().toString() and packing.deal(table.limit(0)).isEmpty()


def test_packing_splits_a_deal_that_one_word_fills(spark):
    table = spark.range(3000).selectExpr("id AS doc_id", "repeat('the same words again ', 400) AS text").repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        sizes = [r["count"] for r in packing.deal(table).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sum(sizes) == 3000 and len(sizes) > 3 and max(sizes) < 1500


def test_packing_is_greedy_by_bm25_and_keeps_its_seed_across_shards():
    rng = random.Random(9)
    topics = [[f"{c}{i}" for i in range(40)] for c in "abcd"]
    shards = [[" ".join(rng.choices(rng.choice(topics), k=rng.randrange(5, 60)) + [f"x{s}y{i}"]) for i in range(60)] for s in range(3)]
    sizes = [[rng.choice([10, 100, 300, 512, 2500]) for _ in s] for s in shards]
    packer, laid = packing.Packer(2048, 0), []
    put = packer.put
    packer.put = lambda doc, ids, done: laid.append(doc) or put(doc, ids, done)
    for texts, lengths in zip(shards, sizes, strict=True):
        index = packing.Index(words.words_of(pa.RecordBatch.from_pydict({"text": texts}), words.ALNUM))
        packing.order(index, packer, texts, [np.arange(n, dtype="<u4") for n in lengths])
    assert laid == brute_order(shards, sizes)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|text|>", "\\", "\\\\<|", "<", "|", "", None, "é🙂<|role|>", "<|<|"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(11) for t, r in enumerate(["system", "user", "assistant", None])]
    rows += [(99, t, "assistant", f"t{t}") for t in range(300)] + [(5, 1, "user", "repeat"), (5, 1, "user", "repeat"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    formatted = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in formatted.collect()}
    read = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert set(got) == {*range(11), 99}
    for conv, r in got.items():
        want = [(role or "", text or "") for c, t, role, text in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert chat.parse(r["formatted"]) == want
        masked = "".join(text for role, text in want if role == "assistant")
        assert "".join(chat.unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss"]) == masked
        d = read[conv]
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (d["n_turns"], d["loss_chars"], d["loss_sha256"], d["formatted_chars"]) == (len(want), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(r["formatted"]))
    assert chat.format_chats(turns.limit(0)).isEmpty()
    assert queries.op7_chat_format(spark, DATA).where("conv_id = -7").first()["n_turns"] == 2


PAGE = """<html><head><title>No</title><style>p{}</style></head><body class="x"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id="sidebar">Side, bar</div>
<article><h1>Head &amp; tail</h1><p>First <b>bold</b>er   text,<br>with a break &lt;p&gt; &eacute;.<p>Second, <a href="x">link</a> para.</p><script>var a="<p>no</p>";</script><ul><li>One<li>Two</ul>
<div class="share">Share!</div><aside>Aside</aside><form><p>Form</p></form><!-- <p>gone</p> --><pre>a
 b</pre></article><section class="comments"><p>A reader says, well, this, that.</p></section><footer>&copy; x</footer>"""


def test_html():
    assert html.main_text(PAGE) == "Head & tail First bolder text, with a break <p> é. Second, link para. One Two a b"
    prose = "Some words, and more words, in a paragraph that goes on for a while, as they do."
    page = f"<div><div class=menu><a href=1>{prose}</a></div><div id=c><h2>T</h2><p>{prose}</p><p>{prose}</p></div><div class='ad'>{prose}</div></div>"
    assert html.main_text(page) == f"T {prose} {prose}"
    for odd in (None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href=\"x>y", "&#0;&bogus;", "<p hidden>no</p>"):
        assert isinstance(html.main_text(odd), str)
    assert html.main_text("<p hidden>no</p>") == "" and html.main_text("<div>" * 3000 + "deep text") == "deep text"


PROSE = "Some words, and more words, in a paragraph that goes on for a while, as they do."


@pytest.mark.parametrize("page, text", [
    (f"<!DOCTYPE html><title>t</title><p>{PROSE} <a href=x>link</a> more</p>", f"{PROSE} link more"),
    (f"{PROSE} <a href=x>link</a> more", f"{PROSE} link more"),
    (f"<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><h1>T</h1><p>{PROSE}</p><p>Read <a href=x>on</a>, please.", f"T {PROSE} Read on, please."),
    ("<a href=1>Home</a> <p><a href=2>News</a>", ""),
    (f"<p>{PROSE}</p><div class=menu>Short</div>", PROSE),
    (f"<html><body><div class='layout with-sidebar'><article><p>{PROSE}</p></article><div class=sidebar>Side, bar</div></div></body></html>", PROSE),
    (f"<body><div id=page class='has-header no-comments'><p>{PROSE}</p><p>{PROSE}</p></div><p>Fine print.</p></body>", f"{PROSE} {PROSE} Fine print."),
    (f"<body><article><div class=no-comments><p>{PROSE}</p></div></article></body>", PROSE),
    (f"<body><article><p>{PROSE}</p></article><div class=comments><p>{PROSE}</p><p>{PROSE}</p></div></body>", PROSE),
    (f"<body><div class=with-sidebar hidden><article><p>{PROSE}</p></article></div></body>", ""),
])
def test_html_without_containers_and_with_misleading_classes(page, text):
    assert html.main_text(page) == text


def test_html_over_the_table(spark):
    got = queries.op6_html_extract(spark, DATA).collect()
    pages = {r["page_id"]: r["html"] for r in whole(spark, "pages").collect()}
    assert len(got) == len(pages) and all(r["text"] and r["n_chars"] == len(r["text"]) for r in got)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        assert r["text"] == " ".join(__import__("html").unescape(re.sub(r"<br>|</?p>|</?h1>", " ", article).replace("<b>", "").replace("</b>", "")).split())
    odd = spark.createDataFrame([(1, None, None, 2), (None, "u", "", 3)], "page_id bigint, url string, html string, text int")
    assert [r["text"] for r in html.extract(odd).collect()] == ["", ""]


def test_language(spark):
    got = queries.op8_language_id(spark, DATA).join(whole(spark).select("doc_id", "lang", "text"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in got)
    docs = documents(spark)
    found = {r["doc_id"]: r for r in language.identify(docs).where("doc_id is not null").collect()}
    assert all(found[i]["lang_pred"] == ("und" if not t or not any(c.isalpha() for c in t) else "en") for i, t in enumerate(ODD))
    assert language.identify(docs.limit(0)).isEmpty()
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_language_of_one_document_is_learned(spark):
    rare = "hyvää huomenta kaikille ystäville täällä pohjoisessa metsässä"
    learned = language.train(whole(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, rare, "fi")], "doc_id bigint, text string, lang string")))
    docs = spark.createDataFrame([(1, rare), (2, "huomenta ystäville pohjoisessa")], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in language.predict(docs, learned).collect()] == ["fi", "fi"]


def test_bloom_filters_hold_every_gram():
    rng = np.random.default_rng(0)
    found = [rng.integers(0, 2**32, 500, dtype=np.uint32) for _ in range(11)]
    model = language.Model.of([f"l{i:02}" for i in range(11)], found)
    for k, values in enumerate(found):
        hits = model.hits(values, np.zeros(len(values), np.int64), 1)[0]
        assert hits.argmax() == k and hits[k] > 0.99 * 500 and max(np.delete(hits, k)) < 25


def brute_licences(texts):
    rows = licences.template_rows()
    for doc, text in texts:
        lines = (text or "").lower().split("\n")
        find = lambda x: re.findall("[a-z0-9]+", x)
        units = [(i + 1, find(x), None) for i, x in enumerate(lines)] + ([(0, find((text or "").lower()), None)] if len(lines) > 1 else [])
        segments = [(i + 1, w) for i, x in enumerate(lines) for p in re.split("[.!?]+[ \t]+", x) if (w := find(p))]
        for k, (line, _) in enumerate(segments):
            following = [w for _, ws in segments[k : k + 400] for w in ws]
            units += [(line, following[:n], n) for n in {n for _, _, n, _ in rows}]
        best = {}
        for unit, w, only in units:
            a = {f"{p} {q}" for p, q in zip(w, w[1:], strict=False)}
            for name, i, n, grams in rows:
                if only not in (None, n):
                    continue
                dice = 2 * len(a & set(grams)) / (len(a) + len(grams))
                if dice >= licences.LEAST:
                    best[unit] = max(best.get(unit, (0,)), (dice, name, -i))
        for unit, (dice, name, i) in best.items():
            yield doc, unit, name, -i, round(dice, 9)


AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."
WRAPPED = "\n".join(re.findall(r".{1,70}(?: |$)", licences.TEMPLATES["MIT"][-1] + " " + AS_IS))


@pytest.mark.parametrize("text, found", [
    (f"Some package\n\nCopyright (c) 2020 Someone\n\n{WRAPPED}\n\nThis sentence stands behind it. And more text follows, about other things.", {(5, "MIT")}),
    ("A story about things.\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files\nand so on it goes.", {(2, "MIT")}),
    ("Thanks for reading this page. Licensed under CC BY 4.0. Bye, and come again.", {(1, "CC-BY-4.0")}),
    ("// SPDX-License-Identifier: GPL-3.0\nint main() { return 0; }", {(1, "GPL-3.0")}),
    ("# SPDX-License-Identifier: Apache-2.0", {(1, "Apache-2.0")}),
    ("word " * 5000 + ". Licensed under the Mozilla Public License, Version 2.0. " + "word " * 3000, {(1, "MPL-2.0")}),
    ("The licensed software may be distributed with permission of the holder.", set()),
])
def test_wrapped_and_embedded_licences(spark, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = {(r["unit"], r["licence"]) for r in licences.best_matches(docs).collect()}
    assert found <= got and {x for _, x in got} == {x for _, x in found}


def test_licences(spark):
    near = ["licensed UNDER the apache license version 2.0", "x\nReleased under the MIT Licence.\nReleased under the MIT License!", "Permission is hereby granted", "MIT", WRAPPED, f"x\n{WRAPPED} And one sentence more stands here.\ny"]
    for docs in (whole(spark), documents(spark, ODD + near)):
        docs = docs.where("doc_id is not null")
        got = {(r["doc_id"], r["unit"], r["licence"], r["template"], round(r["dice"], 9)) for r in licences.best_matches(docs).collect()}
        assert got == set(brute_licences([(r["doc_id"], r["text"]) for r in docs.collect()])) and got
    assert licences.best_matches(docs.limit(0)).isEmpty() and not licences.best_matches(docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(near[0]).alias("text"))).isEmpty()


def test_key_words_are_needed():
    """A unit without any key word of a template misses more bigrams than it may."""
    for *_, grams in licences.template_rows():
        keys = set(licences.all_key_words(licences.template_rows(), licences.LEAST))
        without = [g for g in grams if not keys & set(g.split())]
        assert 2 * len(without) / (len(without) + len(grams)) < licences.LEAST


def test_native_operators_run_no_python(spark):
    for df in (quality.verdicts(whole(spark), whole(spark, "labels")), queries.op9_license_scan(spark, DATA)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
