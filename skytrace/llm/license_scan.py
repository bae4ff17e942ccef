"""License scan by ordered signature rules, with DataFrame functions only.

Signatures (license_rules.py) are regular expressions over a text's words, which are lower-cased and joined by single
blanks. They are grouped by a keyword, whole words that each of their matches holds; only texts that hold the keyword meet
its rules, and keywords are looked for only where their longest word is. Detections are word intervals; one that lies inside
another of higher priority, or of the same priority and greater length, is suppressed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Signature, signatures

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.6
FOUND = "array<struct<start:int,end:int,label:string,priority:int,score:double>>"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _intervals(padded: Column, pattern: Column) -> Column:
    """``start, end`` (words, end exclusive) of each match of a pattern that begins with a blank."""
    gaps = F.transform(F.split(padded, pattern), _spaces)
    sizes = F.transform(F.regexp_extract_all(padded, pattern, F.lit(0)), _spaces)
    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))
    step = F.zip_with(gaps, sizes, lambda g, s: F.struct(g.alias("g"), s.alias("s")))
    return F.aggregate(
        F.filter(step, lambda x: x["s"].isNotNull()),
        empty,
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["s"]).alias("end")))).alias("out"),
            (acc["at"] + x["g"] + x["s"]).alias("at"),
        ),
        lambda acc: acc["out"],
    )


def _base_places(padded: Column, phrase: str, label: str) -> Column:
    found = F.transform(_intervals(padded, F.lit(f" {phrase}(?= )")), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))
    return F.when(F.contains(padded, F.lit(phrase)), found)


def _literal(rules: list[Signature]) -> Column:
    return F.array(*(
        F.struct(F.lit(rf" {r.pattern}(?= )").alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"))
        for r in rules
    ))


def _active(rules: list[Signature], padded: Column) -> Column:
    """The rules whose keyword a text holds."""
    longest: dict[str, dict[str, list[Signature]]] = {}
    for r in rules:
        longest.setdefault(max(r.keyword.split(" "), key=len), {}).setdefault(r.keyword, []).append(r)
    held = lambda words: F.contains(padded, F.lit(f" {words} "))
    of_word = (F.when(held(w), F.flatten(F.array_compact(F.array(*(F.when(held(k), _literal(g)) for k, g in by.items()))))) for w, by in longest.items())
    return F.flatten(F.array_compact(F.array(*of_word)))


def _suppressed(found: Column) -> Column:
    """The detections that no other one suppresses, in order.

    By start, then the longest and the strongest first, whatever suppresses a detection comes before it, and it suffices to look at
    those of the detections left that reach beyond its start.
    """
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("e"), (-x["priority"]).alias("p"), x["label"].alias("label"), x["score"].alias("score"))))
    row = "struct<start:int,e:int,p:int,label:string,score:double>"
    none = F.array().cast(f"array<{row}>")

    def step(acc: Column, x: Column) -> Column:
        near = F.filter(acc["near"], lambda b: b["e"] < -x["start"])
        lost = F.exists(near, lambda b: (b["e"] <= x["e"]) & ((b["p"] < x["p"]) | (b["p"] == x["p"]) & (b["start"] + b["e"] < x["start"] + x["e"])))
        own = F.when(lost, none).otherwise(F.array(x))
        return F.struct(F.concat(acc["out"], own).alias("out"), F.concat(near, own).alias("near"))

    left = F.aggregate(order, F.struct(none.alias("out"), none.alias("near")), step, lambda acc: acc["out"])
    return F.transform(left, lambda x: F.struct(x["start"].alias("start"), (-x["e"]).alias("end"), x["label"].alias("label"), (-x["p"]).alias("priority"), x["score"].alias("score")))


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """Detect licenses in each whole text; the text is left behind.

    Adds ``n_words``, ``n_base``, ``first_word``, ``last_word`` (places of the base phrases), ``base_labels``,
    ``detections`` (array of start, end, label, priority, score; what suppression leaves), ``labels`` (distinct and
    sorted, base ones included) and ``score`` (the largest of the detections' and the base score, else 0).

    Null text has no words, no places and empty lists. Equal intervals with equal priority all stay. Rows are
    treated alone, so repeated ones give equal results, and an empty table gives an empty one; columns that clash are replaced,
    but for names that begin with two underscores, which are the operator's own.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score")
    keep = [c for c in docs.columns if c not in (text_col, *new)]
    words = F.btrim(F.regexp_replace(_ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS, " "))
    df = docs.select(*keep, words.alias("__t"))
    df = df.withColumn("__p", F.concat(F.lit(" "), "__t", F.lit(" ")))
    places = F.array(*(_base_places(F.col("__p"), phrase, label) for phrase, label in BASE.items()))
    df = df.withColumn("__base", F.flatten(F.array_compact(places))).withColumn("__rules", _active(signatures() if rules is None else rules, F.col("__p")))
    found = F.flatten(F.transform("__rules", lambda r: F.transform(_intervals(F.col("__p"), r["pattern"]), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score")))))
    df = df.withColumn("__found", F.when(F.size("__rules") > 0, F.array_distinct(found)))
    df = df.withColumn("detections", F.coalesce(F.when(F.size("__found") > 0, _suppressed(F.col("__found"))), F.array().cast(FOUND)))
    starts = F.transform("__base", lambda x: x["start"])
    return df.select(
        *keep,
        F.when(F.col("__t") == "", 0).otherwise(_spaces(F.col("__t")) + 1).cast("long").alias("n_words"),
        F.coalesce(F.size("__base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("__base", lambda x: x["label"]))), F.array().cast("array<string>")).alias("base_labels"),
        "detections",
    ).withColumn("labels", F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))).withColumn(
        "score",
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)),
    )
