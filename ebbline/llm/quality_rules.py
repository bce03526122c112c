"""Quality rules: a table of thresholds compiled into one projection.

Words are runs of anything but space, tab, line feed, vertical tab, form feed
and carriage return. All measures come from column functions on the row, so
nothing is shuffled and no Python runs.

Defined cases: a null or empty text has no words and fails; repeated rows get
equal results; columns other than ``doc_id`` and ``text`` are not read, so
clashing names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import LINE, words

WINDOW = 8

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was with be as by this are at an from or "
    "de la le les et en un une du des que qui pour par est au "
    "der die das und ist den von zu mit sich auf ein eine nicht dem "
    "el los las y por con para una se del es"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps rows where ``low * per <= scale * measure <= high * per``; a side left None is open."""

    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None
    scale: int = 1


#: Lengths, symbols, stop words and lines. Ratios are in per cent of whole numbers, so every engine agrees.
RULES = (
    Rule("word_chars", "n_words", low=2, high=20),
    Rule("n_symbols", "n_words", high=50, scale=100),
    Rule("n_stop_words", "n_words", low=2, scale=100),
    Rule("n_dup_lines", "n_lines", high=40, scale=100),
)


def _shifted(df: DataFrame, step: int) -> DataFrame:
    """Each hash joined with the one ``step`` places on, which doubles the words it stands for."""
    left = F.greatest(F.size("grams") - step, F.lit(0))
    return df.withColumn(
        "grams",
        F.zip_with(F.slice("grams", 1, left), F.slice("grams", step + 1, left), lambda a, b: F.xxhash64(a, b)),
    )


def _repeated(ordered: Column) -> Column:
    """Starts of the windows whose hash occurs twice or more, in order."""
    return F.sort_array(
        F.transform(
            F.filter(
                ordered,
                lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        )
    )


def measures(docs: DataFrame) -> DataFrame:
    """One row per document with its counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("words", words(F.col("text")))
    df = df.withColumn(
        "lines", F.filter(F.split("text", LINE, -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    stop = F.filter("words", lambda w: w.isin(*STOP_WORDS, *[x.capitalize() for x in STOP_WORDS]))
    df = df.withColumn("n_stop_words", F.size(stop).cast("bigint"))
    n = F.size("words")
    df = df.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_stop_words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("grams"),
    )
    for step in (1, 2, 4):
        df = _shifted(df, step)
    df = df.withColumn("sorted_grams", F.sort_array("grams"))
    # Only texts with a repeated window pay for the sort that finds where it lies.
    df = df.withColumn(
        "ordered",
        F.when(
            F.exists(
                F.zip_with(
                    F.col("sorted_grams"),
                    F.slice("sorted_grams", 2, F.size("sorted_grams")),
                    lambda a, b: F.coalesce(a == b, F.lit(False)),
                ),
                lambda same: same,
            ),
            F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn("places", F.when(F.col("ordered").isNotNull(), _repeated(F.col("ordered"))))
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop(
        "grams", "sorted_grams", "ordered", "places"
    )


def _within(rule: Rule) -> Column:
    value = F.col(rule.measure) * rule.scale
    per = F.col(rule.per) if rule.per else F.lit(1)
    bounds = []
    if rule.low is not None:
        bounds.append(value >= per * rule.low)
    if rule.high is not None:
        bounds.append(value <= per * rule.high)
    return reduce(and_, bounds)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one condition."""
    return reduce(and_, [_within(rule) for rule in rules], F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict for every document."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (
        measures(docs)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )
