"""Quality filtering by a base rule and a learned decision list, with DataFrame functions only.

Statistics of whole texts are computed in the row, without explode or shuffle. The decision list
is learned from labelled rows by sequential covering: a rule is a conjunction of thresholds, grown
on one part of the rows by information gain, pruned on the other part, and the rows it covers are
set aside before the next one. Each step of growing is one aggregation over binned statistics.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.sources.storage import written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Statistics that rules may use: whole numbers, mostly shares in percent.
STATISTICS = ("n_words", "symbols_pct", "upper_pct", "bangs_pct", "dup_lines_pct", "repeat_pct", "distinct_pct", "same_pct", "word_length_x10")


def _next(values: str, by: int) -> Column:
    """The values ``by`` places on, missing at the end."""
    return F.slice(F.col(values), F.lit(by + 1), F.greatest(F.size(values), F.lit(1)))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pct(part: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(100) * part, of), F.lit(0)).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace ``text_col`` by statistics of the whole text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words in 8-word windows
    that occur twice or more in the text) and the shares in STATISTICS. Null text has no words and all
    zeros. Windows are compared by 64-bit hashes within a text. Columns that clash are replaced, and names that begin with two
    underscores are the operator's own. Rows are treated alone, whatever their length; an empty table gives an empty one.
    """
    text, n = F.col("__t"), F.col("n_words")
    keep = [c for c in docs.columns if c not in (text_col, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATISTICS)]
    df = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t")).withColumn("__b", F.btrim("__t", F.lit(BLANKS)))
    df = df.withColumn("__w", F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", r"[\x20\x09-\x0D]+")))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.select(
        *keep, "__h",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count(text, string.ascii_uppercase).alias("__upper"),
        (F.length(text) - F.length(F.replace(text, F.lit("!")))).alias("__bangs"),
        lines.alias("__lines"),
    )
    df = df.withColumn("__x", F.zip_with("__h", _next("__h", 1), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), (a == b).alias("same"))))
    df = df.withColumn("__h2", F.transform("__x", lambda x: x["h"])).withColumn("__same", F.size(F.filter("__x", lambda x: x["same"])))
    df = df.withColumn("__h4", F.zip_with("__h2", _next("__h2", 2), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("__h8", F.zip_with("__h4", _next("__h4", 4), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("__win", F.slice("__h8", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)).cast("int")))
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    df = df.withColumn("__z", F.when(repeats, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.zip_with("__z", _next("__z", 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("__p", F.when(F.col("__z").isNotNull(), F.array_sort(F.array_distinct(F.flatten(pairs)))))
    covered = F.aggregate(
        F.zip_with("__p", _next("__p", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x
    )
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _pct(F.col("n_symbols"), n).alias("symbols_pct"),
        _pct(F.col("__upper"), F.col("word_chars")).alias("upper_pct"),
        _pct(F.col("__bangs"), n).alias("bangs_pct"),
        _pct(F.col("n_dup_lines"), F.size("__lines")).alias("dup_lines_pct"),
        _pct(F.col("n_repeat_words"), n).alias("repeat_pct"),
        _pct(F.size(F.array_distinct("__h")), n).alias("distinct_pct"),
        _pct(F.col("__same"), n).alias("same_pct"),
        F.coalesce(F.try_divide(F.lit(10) * F.col("word_chars"), n), F.lit(0)).cast("long").alias("word_length_x10"),
    )


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: int

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def decision_list(rules: list[Rule]) -> Column:
    """False if a rule rejects the row, else true; the rules are tried in order."""
    out = None
    for rule in rules:
        out = F.when(matches(rule), F.lit(False)) if out is None else out.when(matches(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: DataFrame, cuts: dict[str, list[int]], p0: int, n0: int) -> tuple[float, Condition | None, int, int]:
    """The condition with the largest gain over some rows, from one histogram of all statistics."""
    bins = [F.struct(F.lit(s).alias("s"), sum((F.col(s) > c).cast("int") for c in cuts[s]).alias("b")) for s in cuts]
    table = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.s", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("all"))
    count = {(r["s"], r["b"]): (r["p"], r["all"] - r["p"]) for r in table.collect()}
    best = (0.0, None, p0, n0)
    for s in cuts:
        p = n = 0
        for b, cut in enumerate(cuts[s]):
            dp, dn = count.get((s, b), (0, 0))
            p, n = p + dp, n + dn
            for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                g = _gain(p0, n0, x, y)
                if g > best[0] + 1e-9:
                    best = (g, Condition(s, above, cut), x, y)
    return best


def learn_rules(
    rows: DataFrame, key: str = "doc_id", bad: str = "bad", max_rules: int = 8, max_conditions: int = 3, min_rows: int = 5, min_precision: float = 0.9
) -> list[Rule]:
    """Rules that reject, learned from all labelled rows: the statistics, a key, and ``bad`` (0 or 1).

    A third of the rows (by hash of the key) prunes what the others grow. A rule needs ``min_rows`` bad rows in
    growing, and ``min_precision`` in growing and pruning; learning ends with the first that fails.
    """
    rows = rows.select(*STATISTICS, F.col(bad).cast("int").alias("bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("prune"))
    quantiles = rows.agg(*(F.percentile_approx(s, [i / 24 for i in range(25)], 1000).alias(s) for s in STATISTICS)).first()
    cuts = {s: sorted({int(v) for v in quantiles[s]} | {-1 + int(quantiles[s][0])}) for s in STATISTICS if quantiles[s]}
    rules: list[Rule] = []
    left = rows
    while cuts and len(rules) < max_rules:
        grow, rule = left.where(~F.col("prune")), ()
        first = grow.agg(F.sum("bad").alias("p"), F.count("*").alias("n")).first()
        p, n = first["p"] or 0, first["n"] - (first["p"] or 0)
        if p < min_rows:
            break
        while n and len(rule) < max_conditions:
            gain, condition, x, y = _best(grow.where(matches(rule)), cuts, p, n)
            if condition is None:
                break
            rule, p, n = (*rule, condition), x, y
        test = left.where("prune").agg(
            *(F.sum(F.when(matches(rule[:k]), F.col("bad"))).alias(f"p{k}") for k in range(1, len(rule) + 1)),
            *(F.count(F.when(matches(rule[:k]), 1)).alias(f"n{k}") for k in range(1, len(rule) + 1)), F.count("*").alias("rows"),
        ).first()
        score = {k: ((test[f"p{k}"] or 0) / test[f"n{k}"], test[f"n{k}"]) for k in range(1, len(rule) + 1) if test[f"n{k}"]}
        k = max(score, key=lambda k: (score[k][0], score[k][1], -k), default=len(rule))
        if not rule or p < min_rows or p < min_precision * (p + n) or score and score[k][0] < min_precision:
            break
        rules.append(rule[:k])
        left = left.where(~matches(rule[:k]))
    return rules


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """Statistics of each document, ``base_failed``, and ``kept``: the verdict of base rule and decision list.

    ``labels`` holds ``id_col`` and ``quality_col`` (0 is bad) for some documents; labels without a document and
    null labels count for nothing, and of several labels of a document the lowest counts. Only labelled rows
    that pass the base rule teach the list; without any, the base rule alone decides.
    """
    stats = written(text_statistics(docs, text_col).withColumn("base_failed", base_failed()), "statistics")
    label = labels.where(F.col(quality_col).isNotNull()).groupBy(F.col(id_col)).agg((F.min(quality_col) == 0).cast("int").alias("bad"))
    known = written(stats.where(~F.col("base_failed")).join(label, id_col).select(id_col, *STATISTICS, "bad"), "labelled")
    return stats.withColumn("kept", ~F.col("base_failed") & decision_list(learn_rules(known, id_col)))
