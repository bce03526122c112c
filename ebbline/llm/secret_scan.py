"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of twenty or more key characters. Its class (hexadecimal
or mixed) sets the limit that the Shannon entropy of some window must reach.
Moving the window by one place changes two counts only, so each step updates
the counts and the sum of ``c * log2(c)`` instead of counting again. Strings of
the allow-list are harmless by form, as a whole, and suppressed. Where a base
span covers part of a candidate, what is left of it is judged by itself. Column
functions only.

Defined cases: a null or empty text has no spans; repeated rows get equal
results; other columns than ``doc_id`` and ``text`` are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import count_of, no_spans, spans, written

#: The patterns of the base kinds. Possessive ends and the look behind keep long runs linear.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
UNIT = 1 << 20


@dataclass(frozen=True)
class EntropyRules:
    """Window length, least entropy in bits per character class, and harmless forms."""

    window: int = 20
    hex_bits: float = 3.0
    mixed_bits: float = 3.6
    allowed: tuple[str, ...] = (
        r"^[A-Za-z]+([-_/=+]+[A-Za-z]*)*$",  # words, also joined ones: nothing but letters between the joints
        r"^[0-9]+([-_/=+]+[0-9]*)*$",  # numbers and dates
        r"^[-_=+/]+$",  # rulers
        r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # identifiers by their form
        # alphabets and counting, and nothing else
        r"(?i)^(?:abcdefghijklmnopqrstuvwxyz|0123456789abcdef|0123456789|1234567890|[-_=+/])++$",
    )

    def units(self) -> list[int]:
        """``c * log2(c)`` for every count, in whole units so that sums are exact."""
        return [0] + [round(c * log2(c) * UNIT) for c in range(1, self.window + 2)]

    def most(self, bits: float) -> int:
        """The entropy is ``log2(w) - sum / w``: at least ``bits`` where the sum is at most this."""
        return int(self.window * (log2(self.window) - bits) * UNIT)


def least_sum(codes: Column, rules: EntropyRules) -> Column:
    """The least sum of ``c * log2(c)`` over all windows of the character codes."""
    units = F.array(*[F.lit(u).cast("bigint") for u in rules.units()])
    width = rules.window

    def step(state: Column, at: Column) -> Column:
        entering, leaving = F.get(codes, at), F.when(at >= width, F.get(codes, at - width))
        # First the character that leaves, then the one that enters: each changes one count.
        gone = F.when(leaving.isNull(), F.lit(0).cast("bigint")).otherwise(
            F.get(units, F.get(state["counts"], leaving) - 1) - F.get(units, F.get(state["counts"], leaving))
        )
        before = F.get(state["counts"], entering) - F.when(leaving == entering, 1).otherwise(0)
        total = state["total"] + gone + F.get(units, before + 1) - F.get(units, before)
        counts = F.transform(
            state["counts"],
            lambda c, j: c + F.when(j == entering, 1).otherwise(0) - F.when(j == leaving, 1).otherwise(0),
        )
        least = F.when(at >= width - 1, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0).cast("bigint").alias("total"),
        F.lit((1 << 62)).cast("bigint").alias("least"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["least"])


def _is_secret(value: Column, rules: EntropyRules) -> Column:
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    limit = F.when(value.rlike("^[0-9A-Fa-f]+$"), F.lit(rules.most(rules.hex_bits))).otherwise(
        F.lit(rules.most(rules.mixed_bits))
    )
    harmless = F.lit(False)
    for form in rules.allowed:
        harmless = harmless | value.rlike(form)
    return F.when(harmless, F.lit(False)).otherwise(least_sum(codes, rules) <= limit)


def secret_spans(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """``doc_id``, the base spans and the entropy spans of every document."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    for kind, pattern in some.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind == "assign":
            found = F.when(F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")), found)
        if kind == "access":
            found = F.when(F.contains("text", F.lit("AKIA")), found)
        df = df.withColumn(f"m_{kind}", F.coalesce(found, F.array().cast("array<string>")))
    holds = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8,
        "access": lambda m: F.lit(True),
        "hex": lambda m: F.lit(True),
        "entropy": lambda m: _is_secret(m, rules),
    }
    for rank, (kind, pattern) in enumerate(some.items()):
        df = df.withColumn(f"s_{kind}", spans(F.col("text"), F.col(f"m_{kind}"), pattern, kind, rank, holds[kind]))
    df = df.withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex")))
    beside = F.flatten(F.transform("s_entropy", lambda x: _uncovered(x, F.col("base"), rules)))
    return df.select("doc_id", "base", F.when(F.size("s_entropy") > 0, beside).otherwise(no_spans()).alias("entropy"))


def _uncovered(span: Column, base: Column, rules: EntropyRules) -> Column:
    """A span where no base span touches it, else what they leave of it, where that is a secret by itself."""
    touching = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    state = F.struct(span["start"].alias("at"), no_spans().alias("left"))

    def piece(start: Column, end: Column) -> Column:
        value = F.substr(span["value"], (start - span["start"] + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
        made = F.struct(start.alias("start"), span["rank"].alias("rank"), end.alias("end"), span["kind"].alias("kind"), value.alias("value"))
        return F.when(end - start >= rules.window, F.array(made)).otherwise(no_spans())

    walked = F.aggregate(
        touching,
        state,
        lambda s, b: F.struct(
            F.greatest(s["at"], b["end"]).alias("at"), F.concat(s["left"], piece(s["at"], b["start"])).alias("left")
        ),
        lambda s: F.concat(s["left"], piece(s["at"], span["end"])),
    )
    own = F.filter(walked, lambda p: _is_secret(p["value"], rules))
    return F.when(F.size(touching) == 0, F.array(span)).otherwise(own)


def secret_scan(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    df = secret_spans(docs, rules)
    return df.select(
        "doc_id",
        *[count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
