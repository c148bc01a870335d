"""Quality rules with risk-controlled thresholds, in DataFrame operations alone.

Each rule is a measure of a text that is larger for worse texts. Cutoffs are chosen on labelled rows for each stratum
(language) so that, with confidence ``1 - DELTA`` for all strata at once, at most ``ALPHA`` of the good texts of the
stratum are rejected by all rules together:

* labelled rows are split by a hash of their id: a quarter gives the order of a path, the rest tests it. A stratum's own
  rows count ``OWN`` times beside those of all strata, as its own may be few;
* the path tightens one rule at a time, from no cutoffs at all; each step is the one that catches most bad texts of the
  first part for the good ones it costs. A step is a whole vector of cutoffs, one a rule;
* along the path a step is admissible if the exact binomial tail P(Bin(n, ALPHA) <= k) is at most DELTA / strata, where k
  of the stratum's n good test texts are rejected by any of its cutoffs (a Clopper-Pearson upper bound). Steps are
  tested in order and testing ends at the first failure, so neither steps nor rules need a correction (fixed-sequence
  testing); strata are corrected by Bonferroni's inequality;
* of the admissible steps the first that catches the most bad test texts is used. A stratum with too few good texts for
  any guarantee shares one pooled stratum; without any admissible step only the base rules reject.

One pass computes the measures, which are frozen as small rows (no text). Only counts reach the driver: per stratum, rule
and grid step, then per stratum and step of its path; strata are no more than there are in ``least_good`` labelled rows each.

Defined results: null text has no words; texts without words fail the base rules; null labels and ids aren't used;
documents labelled twice, and repeated rows, count twice and are judged alike; null languages are a language of their own;
without labels no rule but the base rules rejects; an empty table gives an empty result; very long texts are measured
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purlin.llm.common import freeze, quoted

ALPHA, DELTA = 0.02, 0.05
OWN = 2
PART = 4  # one in PART labelled rows orders the path, the others test it
POOLED = "\x01rest"
SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
RULES = {  # rule: its measure, over the columns of measures()
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / n_words",
    "capitals": "n_capitals / word_chars",
    "shouts": "n_shouts / n_words",
    "long_words": "word_chars / n_words / 20",
}
GRID = [round(4.0 * 0.8**i, 6) for i in range(28)]  # 4 down to 0.0097: the loosest first
WINDOW = 5


def _count_of(text: Column, others: str) -> Column:
    """Characters left when all that ``others`` matches is taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """__id, __lang and the counts; each step is a projection of its own, so nothing is computed twice."""
    d = docs.select(quoted(id_col).alias("__id"), quoted(lang_col).cast("string").alias("__lang"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    bare = F.btrim("t", F.lit(SPACE))
    d = d.withColumn("w", F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, SPACES), lambda x: F.xxhash64(x))))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    item = lambda i, k: F.get(F.col("w"), i + F.lit(k))
    d = d.withColumn("h", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[item(i, k) for k in range(WINDOW)]))))
    d = d.withColumn("again", F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h")))
    d = d.withColumn("s", F.expr("case when again then array_sort(transform(h, (x, i) -> struct(x as x, i as i))) end"))
    d = d.withColumn("p", F.expr("case when again then array_sort(transform(filter(s, (e, j) -> coalesce(get(s, j - 1).x = e.x, false) or coalesce(get(s, j + 1).x = e.x, false)), e -> e.i)) end"))
    covered = f"aggregate(p, struct(0 as total, -{WINDOW} as last), (a, x) -> struct(a.total + least({WINDOW}, x - a.last) as total, x as last), a -> a.total)"
    d = d.withColumn("n_repeat_words", F.expr(f"case when again then cast({covered} as bigint) else 0L end"))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    return d.select(
        "__id",
        "__lang",
        "n_words",
        _count_of(F.col("t"), SPACES).alias("word_chars"),
        _count_of(F.col("t"), "[^#*$%&|<>]++").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        _count_of(F.col("t"), "[^A-Z]++").alias("n_capitals"),
        _count_of(F.col("t"), "[^!?]++").alias("n_shouts"),
    )


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly from logarithms."""
    if k >= n:
        return 1.0
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(j)) for j in range(k + 1)))


def least_good(alpha: float, delta: float) -> int:
    """Good texts needed for any guarantee: (1 - alpha) ** n <= delta."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def own_strata(sizes: list[tuple[str, int]], alpha: float, delta: float) -> list[str]:
    """The languages that can pass at the level they are tested at, of (language, good texts) from the largest down."""
    kept = list(sizes)
    while kept and kept[-1][1] < least_good(alpha, delta / (len(kept) + 1)):
        kept.pop()
    return [lang for lang, _ in kept]


def path_of(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[tuple[str, int]]:
    """(rule, grid step) in the order in which cutoffs are tightened. ``good[rule][i]``, ``bad[rule][i]``: texts whose
    measure lies above exactly ``i`` of GRID's cutoffs; a cutoff's place in GRID is its grid step, the loosest is 0.

    The next of each rule is its shortest step that catches more bad texts; of those the one with the best rate of bad
    to good texts comes first.
    """
    top = len(GRID)

    def ahead(rule: str, now: int) -> tuple[float, int, int] | None:
        """(rate, bad texts, grid step) of the rule's next step; texts above ``now`` of the grid are caught already."""
        caught = lost = 0
        for step in range(now + 1, top):  # cutoff GRID[step] catches what lies above at least top - step cutoffs
            caught += bad[rule][top - step]
            lost += good[rule][top - step]
            if caught:
                return caught / (lost + 1), caught, step
        return None

    at, path = {rule: -1 for rule in RULES}, []
    while found := [(nxt[0], nxt[1], rule, nxt[2]) for rule in RULES if (nxt := ahead(rule, at[rule]))]:
        _, _, rule, step = max(found, key=lambda x: (x[0], x[1], x[2]))
        at[rule] = step
        path.append((rule, step))
    return path


def choose_step(good: list[int], bad: list[int], alpha: float, delta: float) -> int | None:
    """``good[j]``, ``bad[j]``: test texts that step ``j`` of the path is the first to reject; the last entry: those that no
    step rejects. The step to use, or None."""
    n, lost, caught, best = sum(good), 0, 0, None
    for j in range(len(good) - 1):
        lost, caught = lost + good[j], caught + bad[j]
        if binomial_tail(n, lost, alpha) > delta:
            break
        if caught and (best is None or caught > best[0]):
            best = (caught, j)
    return best[1] if best else None


def _measure(rule: str) -> Column:
    return F.expr(f"case when n_words > 0 then coalesce({RULES[rule]}, 0.0D) else 0.0D end")


def _steps_above(rule: str) -> Column:
    return sum(((_measure(rule) > c).cast("int") for c in GRID), F.lit(0))


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule. ``measured``: frozen measures()."""
    marks = labels.select(quoted(id_col).alias("__label_id"), quoted(label_col).cast("int").alias("__y")).where("__y in (0, 1)")
    known = measured.join(marks, F.col("__id") == F.col("__label_id")).withColumn("__lang", F.coalesce("__lang", F.lit("")))
    known = known.withColumn("__first", F.pmod(F.xxhash64("__id", F.lit(29)), F.lit(PART)) == 0)
    known = freeze(known.select("__lang", "__y", "__first", *[_steps_above(rule).alias(rule) for rule in RULES]), "holdout")
    # a language with fewer good texts than its stratum could use is pooled; fewer strata are tested at a looser level
    sizes = known.where("__y = 1 and not __first").groupBy("__lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.where(F.col("n") >= least_good(alpha, delta)).orderBy(F.col("n").desc(), "__lang").collect()
    strata = own_strata([(r["__lang"], r["n"]) for r in sizes], alpha, delta)
    stratum = F.when(F.col("__lang").isin(strata), F.col("__lang")).otherwise(F.lit(POOLED)) if strata else F.lit(POOLED)
    placed = known.withColumn("__stratum", stratum)
    none = [0] * (len(GRID) + 1)
    counts: dict[tuple, list[int]] = {}
    each = placed.where("__first").select("__stratum", "__y", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("step")) for rule in RULES])).alias("m"))
    for r in each.groupBy("__stratum", "__y", "m.rule", "m.step").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault((r["__stratum"], r["__y"], r["rule"]), list(none))[r["step"]] += r["n"]
    whole: dict[tuple, list[int]] = {}
    for (_, y, rule), n in counts.items():
        whole[y, rule] = [a + b for a, b in zip(whole.get((y, rule), none), n, strict=True)]
    told = lambda s, y, rule: [OWN * a + b for a, b in zip(counts.get((s, y, rule), none), whole.get((y, rule), none), strict=True)]
    paths = {s: path_of(*({rule: told(s, y, rule) for rule in RULES} for y in (1, 0))) for s in [*strata, POOLED]}
    tables = json.dumps({s: {rule: _first_steps(path, rule) for rule in RULES} for s, path in paths.items()})
    table = F.from_json(F.lit(tables), f"map<string, struct<{', '.join(f'{rule}: array<int>' for rule in RULES)}>>")
    own = F.try_element_at(table, F.col("__stratum"))
    first = F.least(*[F.get(own[rule], F.col(rule)) for rule in RULES])
    rejected: dict[tuple, dict[int, int]] = {}
    for r in placed.where("not __first").groupBy("__stratum", "__y", first.alias("j")).agg(F.count(F.lit(1)).alias("n")).collect():
        rejected.setdefault((r["__stratum"], r["__y"]), {})[r["j"]] = r["n"]
    out: dict[str, dict[str, float]] = {}
    for s, path in paths.items():
        good, bad = ([rejected.get((s, y), {}).get(j, 0) for j in range(len(path) + 1)] for y in (1, 0))
        j = choose_step(good, bad, alpha, delta / (len(strata) + 1))
        out[s] = {rule: GRID[step] for rule, step in path[: j + 1]} if j is not None else {}
    return out


def _first_steps(path: list[tuple[str, int]], rule: str) -> list[int]:
    """By how many of GRID's cutoffs a text's measure lies above: the first step of the path whose cutoff rejects it."""
    top = len(GRID)
    return [next((j for j, (r, step) in enumerate(path) if r == rule and above >= top - step), len(path)) for above in range(top + 1)]


def apply_rules(measured: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """``measured`` with base_failed, failed_rules and kept."""
    table = F.from_json(F.lit(json.dumps(cutoffs)), f"map<string, struct<{', '.join(f'{rule}: double' for rule in RULES)}>>")
    own = F.coalesce(F.try_element_at(table, F.coalesce("__lang", F.lit(""))), F.try_element_at(table, F.lit(POOLED)))
    rows = measured.withColumn("__own", own)
    failed = F.array_compact(F.array(*[F.when(_measure(rule) > F.col(f"__own.{rule}"), F.lit(rule)) for rule in RULES]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__own")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, the counts, base_failed, failed_rules, kept."""
    measured = freeze(measures(docs, id_col, text_col, lang_col), "measures")
    return apply_rules(measured, calibrate(measured, labels, id_col)).withColumnRenamed("__id", id_col).drop("__lang")
