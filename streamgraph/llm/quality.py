"""Operator 1: quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules reject texts of few words or much repetition. Beyond them, each stratum (a language) has a rule: a cutoff
for each signal, above any of which a document goes. Rules are selected on labelled documents from chains that are
fixed beforehand: a chain goes in STEPS steps from the mildest cutoffs of all its signals to the strictest. The first chain has
all signals; the others leave one signal out each, for strata where that one says nothing about quality. Going along a chain, a rule is taken while an exact
binomial test says that the rule as a whole falsely rejects at most ``risk`` of the good documents of the stratum. A
chain is tested in fixed sequence, which needs no correction; the level is divided by the number of strata and over the
chains (Bonferroni; FIRST_SHARE of it for the first). So with probability 1 - ``level`` no stratum's rule falsely rejects
more than ``risk``, whichever of the rules taken is chosen: the one that rejects most labelled bad documents, of
those the fewest good ones, of those the strictest.

A stratum with too few good labels to prove any rule is tested together with all others of that kind; the bound then
holds for that pool of strata, not for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .columns import fresh, let

RISK, LEVEL = 0.01, 0.05
#: Signals, greater is worse, and their cutoffs from the mildest to the strictest; a document above a cutoff is rejected.
GRID = {
    "symbol_share": [0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03],
    "dup_line_share": [0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20],
    "repeat_share": [0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15],
    "word_length": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0],
    "upper_share": [0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30],
    "bang_share": [0.50, 0.40, 0.30, 0.20, 0.15, 0.10, 0.05],
}
#: Steps of a chain; a signal with fewer cutoffs keeps one for several steps. The share of the level that the chain of all signals has.
STEPS, FIRST_SHARE = max(map(len, GRID.values())), 0.75
STRATUM = "lang"
#: Cutoffs are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 10_000
OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "base_failed", "kept", "failed_signals"]


def base(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_bangs and base_failed, all without a shuffle.

    Repeated 3-word windows are found within the row: 64-bit hashes of the windows are sorted with
    their positions, equal neighbours mark positions, and marked windows cover words.
    """
    t, w, same = fresh(docs, "t", "w", "l")
    count = lambda kept: F.length(F.regexp_replace(t, f"[^{kept}]+", "")).cast("bigint")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def repeated(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def covered(h: Column) -> Column:
            marked = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            at = lambda s: F.array_sort(F.transform(marked(s), lambda x: x["i"]))
            cover = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            # most texts repeat no window: a cheap sort of the hashes alone says so
            same = F.size(F.array_distinct(h)) == F.size(h)
            return F.when(same, F.lit(0)).otherwise(let(pairs, lambda s: let(at(s), cover)))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, covered))

    measured = docs.withColumn(t, F.coalesce("text", F.lit(""))).withColumns({
        w: let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated(w).cast("bigint").alias("r"))),
        same: let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    })
    measured = measured.withColumns({
        "n_words": F.col(w)["n"], "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("bigint"), "n_symbols": count("#*$%&|<>"),
        "n_dup_lines": F.col(same), "n_repeat_words": F.col(w)["r"], "n_upper": count("A-Z"), "n_bangs": count("!?"),
    }).drop(t, w, same)
    return measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def signals() -> dict[str, Column]:
    """The signals of a measured document; 0 words give 0."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / words, "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words, "upper_share": F.col("n_upper") / chars, "bang_share": F.col("n_bangs") / words,
    }


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8, and the recurrence back."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    back = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k), X binomial(n, p): the term at k, times the sum of the ratios of the terms below, which falls off geometrically for k < np.

    Beyond 60 standard deviations and 400 terms the rest is below double precision.
    """
    kd, nd = k.cast("double"), n.cast("double")
    term = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p)))
    most = F.least(k, (400 + 60 * F.sqrt(nd * p)).cast("bigint"))
    step = lambda s, j: F.struct(
        (s["total"] + s["ratio"] * (kd - j + 1) * (1 - p) / ((nd - kd + j) * p)).alias("total"), (s["ratio"] * (kd - j + 1) * (1 - p) / ((nd - kd + j) * p)).alias("ratio")
    )
    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("ratio"))
    total = F.aggregate(F.when(most >= 1, F.sequence(F.lit(1).cast("bigint"), most)).otherwise(F.array().cast("array<bigint>")), start, step)["total"]
    return F.least(F.lit(1.0), term * total)


def cutoffs() -> dict[str, list[float]]:
    """Of each signal the cutoff at each step."""
    return {s: [float(cuts[t * len(cuts) // STEPS]) for t in range(STEPS)] for s, cuts in GRID.items()}


def chains() -> list[list[str]]:
    """The signals of each chain."""
    return [list(GRID), *([s for s in GRID if s != left] for left in GRID)]


def levels(level: float) -> list[float]:
    """The level of each chain, before it is divided by the number of strata."""
    return [level * FIRST_SHARE] + [level * (1 - FIRST_SHARE) / len(GRID)] * len(GRID)


def _tests(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Per stratum, chain and step: n good labelled documents, of which k are rejected, and bad ones that are."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    found, cuts = signals(), cutoffs()
    # cutoffs fall from step to step, so a signal rejects from its first step on
    below = lambda signal, c: F.size(F.filter(F.array(*map(F.lit, cuts[signal])), lambda x: x < c))
    first = {s: F.lit(STEPS) - below(s, c) for s, c in found.items()}
    rejects = F.array(*[F.least(*[F.col(f"_{s}") for s in chain]) for chain in chains()])
    rows = measured.where(~F.col("base_failed")).join(known, "doc_id").select("stratum", "good", *[c.alias(f"_{s}") for s, c in first.items()])
    rows = rows.select("stratum", "good", F.posexplode(rejects).alias("chain", "step"))
    counts = rows.groupBy("stratum", "chain", "step").agg(F.count_if("good").alias("k"), F.count_if(~F.col("good")).alias("bad"))
    steps = measured.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(len(GRID)))).alias("chain"))
    steps = steps.select("stratum", "chain", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("step"))
    whole = Window.partitionBy("stratum", "chain")
    so_far = whole.orderBy("step")
    tests = steps.join(counts, ["stratum", "chain", "step"], "left").na.fill(0, ["k", "bad"])
    tests = tests.withColumns({"n": F.sum("k").over(whole), "k": F.sum("k").over(so_far), "bad": F.sum("bad").over(so_far)})
    return tests.where(F.col("step") < STEPS)


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Per stratum and signal the selected cutoff (null: none): from all labelled documents that pass the base rules.

    A stratum with too few good labels to prove any rule borrows those of the pool of all such strata, or if that is too
    small as well, those that hold in every stratum with enough; but none that rejects more than ``risk`` of its own good labels.
    Strata without labels borrow as well. Without any labels there are no rows.

    measured: the output of ``base``, with a column ``stratum``. labels: doc_id, quality (1: good). A document with several
    labels counts as good only if none says otherwise; labels with null are not read.
    """
    tests = scratch.keep(_tests(measured, labels), "tests")
    strata = scratch.keep(tests.where("chain = 0 and step = 0").agg(F.count_if(F.col("n") > 0).alias("n_strata")).where("n_strata > 0"), "strata")  # one row at most
    tests = tests.join(F.broadcast(strata), F.lit(True))
    bound = lambda chain: F.get(F.array(*map(F.lit, levels(level))), chain) / F.col("n_strata")
    enough = lambda n: n * F.log(F.lit(1 - risk)) <= F.log(bound(F.lit(0)))
    held = lambda k, n: binomial_tail(k, n, risk) <= bound(F.col("chain"))
    # whether a stratum stands alone is told by n only, so the tests keep their level; the pool takes the place of one small stratum at least in the correction
    tests = tests.withColumn("alone", enough(F.col("n")))
    rule, so_far = Window.partitionBy("chain", "step"), Window.partitionBy("stratum", "chain").orderBy("step")
    small = lambda c: F.sum(F.when(~F.col("alone"), F.col(c))).over(rule)
    tests = tests.withColumns({"pool_n": small("n"), "pool_k": small("k"), "all_bad": F.sum("bad").over(rule), "own": F.min(F.when(F.col("alone"), held(F.col("k"), F.col("n")))).over(so_far)})
    everywhere = F.coalesce(F.min("own").over(rule), F.lit(False))
    tests = tests.withColumn("lent", F.when(enough(F.col("pool_n")), held(F.col("pool_k"), F.col("pool_n"))).otherwise(everywhere) & (F.col("k") <= risk * F.col("n")))
    tests = tests.withColumn("taken", F.coalesce("own", F.min("lent").over(so_far)))
    caught = F.when(F.col("alone"), F.col("bad")).otherwise(F.col("all_bad"))
    best = tests.groupBy("stratum").agg(F.max(F.when(F.col("taken"), F.struct(caught.alias("caught"), (-F.col("k")).alias("k"), "step", (-F.col("chain")).alias("chain")))).alias("best"))
    at = lambda s, cuts: F.when(~(-F.col("best.chain")).isin([i for i, chain in enumerate(chains()) if s not in chain]), F.get(F.array(*map(F.lit, cuts)), F.col("best.step")))
    return best.select("stratum", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), at(s, cuts).alias("cutoff")) for s, cuts in cutoffs().items()])))


def _stratified(docs: DataFrame) -> DataFrame:
    """``base`` with ``stratum``: ``=`` and the language, or nothing where that is null."""
    return base(docs.drop(*OWN, "stratum")).withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col(STRATUM).cast("string")), F.lit("")))


def decide(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Measured rows with ``failed_signals`` and ``kept``, by the cutoffs of their stratum."""
    (cut,) = fresh(rows, "cut")
    rules = chosen.where("cutoff is not null").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias(cut))
    few = chosen.count() <= BROADCAST_ROWS  # one row per stratum and signal
    joined = rows.join(F.broadcast(rules) if few else rules, "stratum", "left")
    above = F.array_compact(F.array(*[F.when(c > F.col(cut)[s], F.lit(s)) for s, c in signals().items()]))
    judged = joined.withColumn("failed_signals", above).withColumn("kept", ~F.col("base_failed") & (F.size("failed_signals") == 0))
    return judged.drop(cut)


def _judged(docs: DataFrame, labels: DataFrame, risk: float, level: float) -> DataFrame:
    """Rows are measured once and written; their own columns go with them."""
    rows = scratch.keep(_stratified(docs), "measured")
    return decide(rows, scratch.keep(thresholds(rows, labels, risk, level), "thresholds"))


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``judge`` without the texts and further columns: doc_id, stratum, the columns of ``base``, ``failed_signals``, ``kept``. Texts are read, but neither written nor shuffled."""
    rows = scratch.keep(_stratified(docs.select("doc_id", "text", STRATUM)).select("doc_id", "stratum", *OWN[:-2]), "measured")
    return decide(rows, scratch.keep(thresholds(rows, labels, risk, level), "thresholds"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``docs`` with the columns of ``base``, ``kept`` and ``failed_signals`` (which cutoffs it is above).

    Null or empty texts have no words and fail the base rules. Null strata are one stratum of their own. A stratum
    without enough labels takes the rule of the pool (see ``thresholds``); where that proves none either, only the base rules hold. Rows with null or repeated ids are judged
    each by their own text. Columns of ``docs`` with the names added here (``OWN`` and ``stratum``) are replaced; empty tables give no rows.
    """
    return _judged(docs, labels, risk, level).drop("stratum")
