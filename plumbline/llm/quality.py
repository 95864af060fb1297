"""Quality rules with risk-controlled thresholds.

Each text gets a few counts. A rule turns counts into a badness that rejects from a cutoff on, and the cutoff of a rule in
a stratum is learned from labelled documents. Cutoffs are tried from the mildest to the strictest; one is accepted while
the exact binomial bound on its rate of false rejections (documents labelled good that it would reject) stays within the
rule's share of ``alpha``. Testing in this fixed order needs no correction along the grid; over strata and rules the error
``delta`` is divided by their number (Bonferroni). So with probability ``1 - delta`` no stratum loses more than ``alpha``
of its good documents. Everything is DataFrame expressions; the windows of words are handled inside a row.

Defined results: a null or empty text has zero counts and fails the base rule; a null lang is a stratum of its own; rows
of ``labels`` without a document, a quality or an id are ignored, and a document labelled both good and bad counts as bad;
a stratum with too few labels keeps all that pass the base rule; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, let, small_side, text_or_empty, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: At most this share of a stratum's good documents may be rejected by all rules together, with this probability of error.
ALPHA, DELTA = 0.05, 0.05

#: Rules: name -> cutoffs from the mildest to the strictest. A document is rejected if its badness reaches the cutoff.
RULES = {
    "symbols": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "dup_lines": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeats": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "word_length": (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
}


#: Up to so many repeated windows are looked up one by one; beyond, (hash, position) pairs are sorted.
FEW = 24


def repeated_words(ws: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are hashed (64 bits) and the hashes sorted; equal neighbours are the repeated windows, and most texts have few
    or none. Their positions in order add up as ``min(3, distance to the next one)``.
    """

    def total(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def looked_up(h: Column, again: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i))
        return let(F.array_compact(at), total)

    def sorted_pairs(h: Column) -> Column:
        def positions(s: Column) -> Column:
            hit = F.transform(s, lambda x, i: F.when((F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]), x["i"]))
            return let(F.sort_array(F.array_compact(hit)), total)

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), positions)

    def of_hashes(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False)))))
        return let(again, lambda a: F.when(F.size(a) == 0, F.lit(0)).when(F.size(a) <= FEW, looked_up(h, a)).otherwise(sorted_pairs(h)))

    windows = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), 1, F.greatest(F.size(ws) - 2, F.lit(0)))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(windows, of_hashes)).cast("long")


def counts(text: Column) -> Column:
    """The counts of one text as a struct: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
        word_counts = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"), F.length(F.array_join(w, "")).alias("c")))
        symbols = F.length(F.regexp_replace(t, F.lit(f"[^{SYMBOLS}]+"), F.lit("")))
        return let(
            F.struct(line_counts.alias("l"), word_counts.alias("w")),
            lambda b: F.struct(
                b["w"]["n"].cast("long").alias("n_words"),
                b["w"]["c"].cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                b["l"]["n"].cast("long").alias("n_lines"),
                b["l"]["d"].cast("long").alias("n_dup_lines"),
                b["w"]["r"].alias("n_repeat_words"),
            ),
        )

    return let(text_or_empty(text), of)


def _badness(rule: str) -> Column:
    over = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / over,
        "word_length": F.col("word_chars") / over,
    }[rule]


def level_of(rule: str) -> Column:
    """How many of the rule's cutoffs reject the document: the strictest ones first, as a mild cutoff rejects less."""
    return sum((F.when(_badness(rule) >= F.lit(c), 1).otherwise(0) for c in RULES[rule]), F.lit(0))


def log_factorial(n: Column) -> Column:
    """ln(n!) to about 1e-12: Stirling's series at n + 10, brought back by the ten factors between."""
    x = n.cast("double") + 10.0
    series = 1 / (12.0 * x) - 1 / (360.0 * x * x * x) + 1 / (1260.0 * x * x * x * x * x)
    back = sum((F.log(n + float(j)) for j in range(2, 11)), F.log(n + 1.0))
    return (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly summed downward from its largest term; terms below 1e-30 of it are past the sum's range."""
    log_top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, F.ceil(12.0 * F.sqrt(n.cast("double")) + 60.0)).cast("int")
    odds = (1 - p) / p
    step = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        i = k - j + 1
        term = s["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(reach >= 1, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>")), step, add, lambda s: s["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Documents with the levels of their rules, ``stratum`` and ``good`` -> (stratum, a level to reject from, by rule).

    Counts by (stratum, rule, level) are pre-aggregated; a window over the few levels of a rule gives, for each cutoff,
    the good documents it rejects. The strictest cutoff that all milder ones hold beside is chosen. A level of 99 rejects
    nothing.
    """
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"level_{r}").alias("level")) for r in RULES])).alias("e")
    tally = labelled.filter("good").select("stratum", each).groupBy("stratum", "e.rule", "e.level").agg(F.count(F.lit(1)).alias("c"))
    strata = labelled.filter("good").select("stratum").distinct()
    grid = strata.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("level")) for r in RULES for i in range(len(RULES[r]) + 1)])).alias("e")).select("stratum", "e.rule", "e.level")
    g = grid.alias("g").join(tally.alias("t"), F.col("g.stratum").eqNullSafe(F.col("t.stratum")) & (F.col("g.rule") == F.col("t.rule")) & (F.col("g.level") == F.col("t.level")), "left")
    g = g.select("g.stratum", "g.rule", "g.level", F.coalesce("c", F.lit(0)).alias("c"))
    by = Window.partitionBy("stratum", "rule")
    # a document of level i is rejected by the i strictest cutoffs, so the mildest rejects from the highest level on
    g = g.withColumn("k", F.sum("c").over(by.orderBy(F.desc("level")))).withColumn("n", F.sum("c").over(by))
    tests = max(1, strata.count()) * len(RULES)
    passes = binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= F.lit(delta / tests)
    g = g.filter("level > 0")
    g = g.withColumn("holds", F.min(passes.cast("int")).over(by.orderBy(F.desc("level"))))
    at = g.filter("holds = 1").groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("level"))
    return at.select("stratum", *[F.coalesce(F.col(r), F.lit(99)).alias(f"from_{r}") for r in RULES])


def assess(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept.

    The counts of all documents are written once to the shared checkpoint folder (some 100 bytes a document); labels
    join them there, so no text is read twice or shuffled.
    """
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("stratum"), counts(F.col("text")).alias("c")).select("doc_id", "stratum", "c.*")
    rows = rows.select("*", *[level_of(r).alias(f"level_{r}") for r in RULES])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = cut(rows.withColumn("base_failed", base))
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    cutoffs = choose_cutoffs(rows.filter("not base_failed").join(good, "doc_id"), alpha, delta)
    cutoffs = small_side(cutoffs.withColumnRenamed("stratum", "__stratum"))
    rows = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"level_{r}") >= F.coalesce(F.col(f"from_{r}"), F.lit(99)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))

