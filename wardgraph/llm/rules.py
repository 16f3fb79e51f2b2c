"""Quality rules as a learned decision list, in DataFrame functions alone.

Statistics of every text are computed with Spark's built-in functions. A list of rules is learned from labelled rows by
sequential covering: a rule is a conjunction of conditions ``statistic >= t`` or ``statistic < t`` that finds bad rows. It is
grown on two thirds of the labelled rows by FOIL gain, and its last conditions are pruned on the other third; it is taken if it
is precise there, the rows it covers are set aside, and the next rule is grown. The list becomes one ordered Spark conditional
expression: the first rule that holds rejects, and a row that no rule covers is kept.

Candidate thresholds lie in the middle between neighbours among the quantiles of good rows and of bad ones; of conditions with equal gain
the one in the widest gap wins, so that a rule keeps its distance from both kinds. Labelled rows are reduced to cells (a bin for each
statistic) with counts; each step of growing and pruning is an aggregate of the cells, of which the driver gets a count for each bin.

A null text has no words. A row without a word, or with a null id, is treated like any other (so it fails the base rule). Several
labels of an id are averaged, half counting as good; null labels don't count; without labels of both classes the list is empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts

SPACE = r"[\x09-\x0D\x20]+"
WINDOW = 8
#: What rules are made of, each from the counts below.
STATISTICS = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, and STATISTICS, for every row of ``docs``."""
    only = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", ""))
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(
        "doc_id",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]")).alias("lines"),
        only("#*$%&|<>").alias("n_symbols"),
        only(r"\p{Lu}").alias("n_upper"),
        only("!").alias("n_bangs"),
    )
    windows = F.size("words") - (WINDOW - 1)
    hashes = F.when(windows > 0, F.transform(F.sequence(F.lit(1), F.greatest(windows, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        "n_upper",
        "n_bangs",
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    # windows in order of (hash, place), for the few texts in which one occurs twice
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("ordered", ordered).drop("hashes")
    same = lambda x, j: F.coalesce(F.get("ordered", j)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("ordered", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_bangs", "n_distinct", "n_lines"]
    rows = rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts], F.when(F.col("ordered").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))
    return rows.select("*", *[F.expr(x).alias(f"s_{name}") for name, x in STATISTICS.items()])


@dataclass(frozen=True)
class Condition:
    """``statistic >= t`` (above) or ``statistic < t``; ``step``: t is the step-th threshold of the statistic."""

    statistic: str
    above: bool
    t: float
    step: int

    def holds(self) -> Column:
        return F.col(f"s_{self.statistic}") >= self.t if self.above else F.col(f"s_{self.statistic}") < self.t

    def on_bins(self) -> Column:
        return F.col(f"b_{self.statistic}") > self.step if self.above else F.col(f"b_{self.statistic}") <= self.step

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.t:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions, form) -> Column:
    return reduce(lambda a, b: a & b, [form(c) for c in conditions], F.lit(True))


def thresholds(rows: DataFrame, steps: int = 16) -> dict[str, list[tuple[float, float]]]:
    """(t, gap) of each statistic: the middle between neighbours among the quantiles, ends included, of good rows and of bad ones, and how
    far they are apart, as a share of the whole range."""
    at = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    of = lambda s, rows: F.coalesce(F.percentile_approx(F.when(rows, F.col(f"s_{s}")), at, 1000), F.array().cast("array<double>"))
    found = rows.agg(*[F.array_union(of(s, F.col("good")), of(s, ~F.col("good"))).alias(s) for s in STATISTICS]).first()
    return {s: [((a + b) / 2, (b - a) / (max(found[s]) - min(found[s]))) for a, b in pairwise(sorted({*found[s]}))] for s in STATISTICS}


def learn_rules(rows: DataFrame, max_rules: int = 8, max_conditions: int = 4, precision: float = 0.95, least_share: float = 0.001) -> list[Rule]:
    """A decision list from rows with doc_id, the s_ columns and good (boolean). A taken rule covers at least ``least_share``
    of the bad rows and has ``precision`` on the pruning rows."""
    at = thresholds(rows)
    bins = [reduce(lambda a, b: a + b, [(F.col(f"s_{s}") >= t).cast("int") for t, _ in at[s]], F.lit(0)).cast("tinyint").alias(f"b_{s}") for s in STATISTICS]
    split = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("prune")
    cells = rows.select(*bins, "good", split).groupBy(*[f"b_{s}" for s in STATISTICS], "good", "prune").agg(F.count("*").alias("n"))
    cells = materialise(cells, "cells").persist()
    bad = F.sum(F.when(~F.col("good"), F.col("n")).otherwise(0)).cast("long")
    good = F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).cast("long")
    total_bad = cells.agg(bad).first()[0] or 0
    rules: list[Rule] = []
    left = cells
    try:
        while len(rules) < max_rules:
            rule = _grown(left.where(~F.col("prune")), at, max_conditions, bad, good)
            if not rule:
                break
            prefixes = [_all(rule[: k + 1], Condition.on_bins) for k in range(len(rule))]
            sums = left.where("prune").agg(*[F.coalesce(F.sum(F.when(p & (F.col("good") == g), F.col("n"))), F.lit(0)).alias(f"c{k}_{int(g)}") for k, p in enumerate(prefixes) for g in (False, True)]).first()
            worth = [((sums[f"c{k}_0"] - sums[f"c{k}_1"]) / max(1, sums[f"c{k}_0"] + sums[f"c{k}_1"]), -k) for k in range(len(rule))]
            k = -max(worth)[1]
            rule = rule[: k + 1]
            hit, miss = sums[f"c{k}_0"], sums[f"c{k}_1"]
            if hit < precision * (hit + miss) or hit < max(2, least_share * total_bad / 3):
                break
            rules.append(rule)
            left = left.where(~_all(rule, Condition.on_bins))
    finally:
        cells.unpersist()
    return rules


def _grown(cells: DataFrame, at: dict[str, list[tuple[float, float]]], most: int, bad: Column, good: Column) -> Rule:
    """Adds the condition of most FOIL gain, of equals that in the widest gap, until no good row is covered, nothing gains, or the rule has
    ``most`` conditions."""
    rule: Rule = ()
    while len(rule) < most:
        flat = cells.where(_all(rule, Condition.on_bins)).select("good", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"b_{s}").alias("b")) for s in STATISTICS])).alias("x"))
        counts = flat.groupBy("x.s", "x.b").agg(bad.alias("bad"), good.alias("good")).collect()  # a row for each bin
        by = {s: [(0, 0)] * (len(at[s]) + 1) for s in STATISTICS}
        for r in counts:
            by[r["s"]][r["b"]] = (r["bad"], r["good"])
        p0, n0 = (sum(x[i] for x in by["n_words"]) for i in (0, 1))
        if not p0 or not n0:
            break
        best = (2e-9, 0.0, None)
        for s, edges in at.items():
            below = (0, 0)
            for step, (t, gap) in enumerate(edges):
                below = (below[0] + by[s][step][0], below[1] + by[s][step][1])
                for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                    if not p:
                        continue
                    gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9 or (gain > best[0] - 1e-9 and gap > best[1]):
                        best = (gain, gap, Condition(s, above, t, step))
        if best[2] is None:
            break
        rule += (best[2],)
    return rule


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    out = F
    for i, rule in enumerate(rules, 1):
        out = out.when(_all(rule, Condition.holds), F.lit(i))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """doc_id, the counts, base_failed, kept, rule (number of the rule that rejected, 0 for none). Rules are learned from
    labelled rows that pass the base rule."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = materialise(statistics(docs, id_col, text_col).withColumn("base_failed", failed), "statistics")
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("q")).where("doc_id is not null and q is not null")
    named = named.groupBy("doc_id").agg((F.avg("q") >= 0.5).alias("good"))
    rules = learn_rules(rows.where("not base_failed").join(named, "doc_id"))
    rule = F.when(F.col("base_failed"), 0).otherwise(verdict(rules)).cast("int")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (rule == 0)).alias("kept"), rule.alias("rule"))
