"""Personal data: fixed patterns, and terms that disclose the found values.

After Shannon, a term in the documents of a protected value tells as much about
it as the corpus says: the pointwise mutual information of term and value, as a
share of the information in the value itself. One means that whoever reads the
term knows the value. Terms above a threshold are marked wherever they stand, in
every document, and the sanitiser replaces them like the values. Counts of
terms, values and both together are of whole documents and cover all of them.

Few common documents may be chance, so a pair also needs evidence, of one of two
kinds. By Hoeffding's bound its different texts must be so unlikely that among all
pairs looked at not even one would be expected by chance (``risk``). Only values
of several texts are looked at: every rare word of a single text would tell as
much. Texts of one origin (copies, and texts that share half or more of their runs
of five words) share the weight of one, since whatever one took from another stands
in both. Or the term is spelled in the name of an address (more than half of
a run of its letters, at either end), stands beside the address in a document too,
and most documents with the term hold that address; one text is then enough.
Column functions only.

Defined cases: a null text counts as empty; a null ``doc_id`` is a key like any
other; repeated rows get equal results; only ``doc_id`` and ``text`` are read;
empty tables give empty results, and in a table of one document nothing tells more
than the table does. Ties do not arise: every term is judged by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import count_of, no_spans, spans, stored, words, written

#: The patterns of the base kinds. Possessive repeats and looks behind match the same strings in one pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A cheap test that a text may hold the kind.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}{3,}"
#: Texts that share half of their runs of five words meet in one of so many groups of so many smallest hashes (0.93 of them
#: do, of those that share 0.8 all but 1e-6), and are of one origin if of all these hashes a share of ``KIN`` is equal too.
BANDS, ROWS, SHINGLE, KIN = 20, 3, 5, 0.42
#: The weight of a text, in whole numbers, so that sums do not depend on their order.
WHOLE = 1 << 32


@dataclass(frozen=True)
class DisclosureRules:
    """What share of the value's information a term may tell, and the risk that chance alone marks any term."""

    threshold: float = 0.8
    risk: float = 0.05


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    if kind == "ip":
        # A part of more than nine digits is over 255 once its leading zeros are gone.
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return digits.between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id``, a digest of the text and the sorted base spans of every document."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    for kind, pattern in KINDS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind in HINTS:
            found = F.when(F.contains("text", F.lit(HINTS[kind])), found)
        df = df.withColumn(f"m_{kind}", F.coalesce(found, F.array().cast("array<string>")))
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        held = spans(F.col("text"), F.col(f"m_{kind}"), pattern, kind, rank, lambda m, k=kind: _holds(k, m))
        df = df.withColumn(f"s_{kind}", held)
    df = df.withColumn("base", F.array_sort(F.concat(*[f"s_{kind}" for kind in KINDS])))
    return df.select("doc_id", "text_key", *(["text"] if keep_text else []), "base")


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def _held(pieces: DataFrame) -> DataFrame:
    """The documents with values: digest, text, values written in one way, and terms."""
    key = lambda s: F.concat_ws(":", s["kind"], F.lower(F.regexp_replace(s["value"], r"[\x20()-]", "")))
    return pieces.where(F.size("base") > 0).select(
        "text_key", "text", "base", F.array_distinct(F.transform("base", key)).alias("entities"), _terms(F.col("text")).alias("terms")
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a column named inside a function over an array is computed at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _least(text: Column) -> Column:
    """The smallest hashes of the runs of words."""

    def runs(own: Column) -> Column:
        last = F.greatest(F.size(own) - SHINGLE, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(own, i + 1, SHINGLE)))

    def least(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), lambda k: F.array_min(F.transform(found, lambda h: F.hash(h, k))))

    return _bound(words(text), lambda own: _bound(runs(own), least))


def _bands(least: str) -> Column:
    """Number and digest of each group of smallest hashes."""
    key = lambda b: F.xxhash64(F.slice(least, b * ROWS + 1, ROWS))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), key(b).alias("key")))


def weights(rows: DataFrame) -> DataFrame:
    """``entity``, ``text_key``, the text's copies and the weight of each, for values of several different texts.

    How many texts of its origin there are among those with the value divides a text's weight.
    """
    texts = rows.select("text_key", F.explode("entities").alias("entity")).groupBy("entity", "text_key").agg(F.count("*").alias("copies"))
    several = texts.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    texts = stored(texts.join(several, "entity", "left_semi"), "personal-texts")
    wanted = rows.join(texts.select("text_key").distinct(), "text_key", "left_semi")
    signed = stored(wanted.dropDuplicates(["text_key"]).select("text_key", _least(F.col("text")).alias("least")), "personal-least")
    group = ["entity", "band", "key"]
    bands = texts.join(signed, "text_key").select("entity", "text_key", "copies", "least", F.inline(_bands("least")))
    bands = stored(bands, "personal-bands")
    # A group's texts are held against its first one, never against each other.
    firsts = bands.groupBy(*group).agg(F.min_by("least", "text_key").alias("first"))
    same = F.size(F.filter(F.zip_with("least", "first", lambda x, y: x == y), lambda equal: equal))
    kin = bands.join(firsts, group).select(*group, "text_key", "copies", (same >= KIN * BANDS * ROWS).alias("kin"))
    kin = stored(kin, "personal-kin")
    alike = kin.groupBy(*group).agg(F.count_if("kin").alias("alike"))
    own = F.max(F.when(F.col("kin"), F.col("alike")).otherwise(1)).alias("alike")
    most = kin.join(alike, group).groupBy("entity", "text_key", "copies").agg(own)
    return most.select("entity", "text_key", "copies", F.floor(F.lit(float(WHOLE)) / (F.col("alike") * F.col("copies"))).alias("weight"))


def pairs(rows: DataFrame) -> DataFrame:
    """Pairs of term and value of several texts that share a document: in how many documents, in how many
    independent texts (``texts_both``), and the value's own numbers.
    """
    held = stored(weights(rows), "personal-weights")
    values = held.groupBy("entity").agg(
        F.sum("copies").alias("n_entity"), (F.sum(F.col("weight") * F.col("copies")) / WHOLE).alias("texts_entity")
    )
    both = (
        rows.select("text_key", "terms", F.explode("entities").alias("entity"))
        .join(held, ["entity", "text_key"])
        .select("entity", "weight", F.explode("terms").alias("term"))
        .groupBy("term", "entity")
        .agg(F.count("*").alias("n_both"), (F.sum("weight") / WHOLE).alias("texts_both"))
    )
    return both.join(values, "entity")


def spelled(rows: DataFrame) -> DataFrame:
    """Pairs of an address and a term that its name spells and that also stands beside it: documents of both and of the address."""
    name = F.substring_index(F.substring("entity", len("email:") + 1, F.length("entity")), "@", 1)
    runs = F.regexp_extract_all(name, F.lit("[a-z]{3,}"), F.lit(0))
    every = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower)
    inside = F.flatten(
        F.transform("base", lambda b: F.transform(F.regexp_extract_all(b["value"], F.lit(TERM), F.lit(0)), F.lower))
    )
    one = rows.select("text", "base", "terms", F.explode("entities").alias("entity")).where(F.col("entity").startswith("email:"))
    of = lambda t, r: (2 * F.length(t) > F.length(r)) & (F.startswith(r, t) | F.endswith(r, t))
    named = _bound(runs, lambda own: F.filter("terms", lambda t: F.exists(own, lambda r: of(t, r))))
    times = lambda found, t: F.size(F.filter(found, lambda w: w == t))
    placed = lambda t, all_, own: F.struct(t.alias("term"), (times(all_, t) > times(own, t)).alias("beside"))
    beside = _bound(every, lambda all_: _bound(inside, lambda own: F.transform("named", lambda t: placed(t, all_, own))))
    one = one.withColumn("named", named)
    numbers = one.groupBy("entity").agg(F.count("*").alias("n_entity"))
    found = one.where(F.size("named") > 0).select("entity", F.inline(beside)).groupBy("term", "entity")
    return found.agg(F.count("*").alias("n_both"), F.max("beside").alias("beside")).where("beside").drop("beside").join(numbers, "entity")


def _evidence(n_term: Column, n_docs: Column) -> Column:
    """At least minus the logarithm of the chance that so many of the value's texts hold the term (Hoeffding's bound)."""
    share, rate = F.col("texts_both") / F.col("texts_entity"), n_term / n_docs
    rest = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when(share > rate, F.col("texts_entity") * (share * F.ln(share / rate) + rest)).otherwise(0.0)


def term_counts(docs: DataFrame) -> DataFrame:
    """In how many documents each term stands.

    Counted before the terms meet any pairs: each task hands on a word once, not once per document. A left semi join
    would be moved below the count, and where Spark then joins by sorting, every word of every document is exchanged.
    """
    return docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def disclosing(docs: DataFrame, pieces: DataFrame, rules: DisclosureRules) -> DataFrame:
    """Terms that disclose a value beyond the threshold and beyond chance."""
    rows = _held(pieces)
    both = stored(pairs(rows), "personal-pairs")
    n_docs = F.lit(float(docs.count()))
    # Any of the pairs may be one by chance: the allowed risk is shared among them all.
    least = F.lit(log(max(both.count(), 1) / rules.risk))
    # A term has at least the documents of the pair; pairs that chance explains even then need no count of it.
    several = F.col("texts_both") > 2 - 1e-3
    likely = both.where(several & (_evidence(F.col("n_both"), n_docs) >= least)).withColumn("spelled", F.lit(False))
    likely = stored(likely.unionByName(spelled(rows).withColumn("spelled", F.lit(True)), allowMissingColumns=True), "personal-likely")
    terms = term_counts(docs)
    told = F.ln(n_docs * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    own = F.ln(n_docs / F.col("n_entity"))
    beyond = F.when(F.col("spelled"), 2 * F.col("n_both") > F.col("n_term")).otherwise(_evidence(F.col("n_term"), n_docs) >= least)
    return likely.join(terms, "term").where((own > 0) & (told >= own * rules.threshold) & beyond).select("term").distinct()


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and every occurrence of the terms, of the documents that have one."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    told = (
        own.select("doc_id", "text_key", F.explode(_terms(F.col("text"))).alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("term").alias("told"))
    )
    told = stored(told, "personal-told").select(F.col("doc_id").alias("told_id"), F.col("text_key").alias("told_key"), "told")
    key = F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("text_key") == F.col("told_key"))
    found = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    gaps = F.slice(F.split("text", TERM, -1), 1, F.size(found))
    # One pass from left to right; only what is marked is gathered.
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("word")))

    def add(done: Column, x: Column) -> Column:
        start = done["total"] + x["gap"]
        end = start + F.length(x["word"])
        span = F.struct(
            start.alias("start"),
            F.lit(len(KINDS)).alias("rank"),
            end.alias("end"),
            F.lit("term").alias("kind"),
            F.lit("").alias("value"),
        )
        seen = F.when(F.array_contains("told", F.lower(x["word"])), F.concat(done["seen"], F.array(span)))
        return F.struct(end.alias("total"), seen.otherwise(done["seen"]).alias("seen"))

    none = F.struct(F.lit(0).cast("bigint").alias("total"), no_spans().alias("seen"))
    marked = F.aggregate(steps, none, add, lambda done: done["seen"])
    # The marked documents grow with the corpus: planned for that at every size, so one exchange of the texts, in proportion.
    rows = own.join(told.hint("merge"), key)
    return rows.select("doc_id", "text_key", marked.alias("marked")).dropDuplicates(["doc_id", "text_key"])


def personal_spans(docs: DataFrame, rules: DisclosureRules = DisclosureRules()) -> DataFrame:
    """``doc_id``, ``text_key``, base spans and term spans of every document."""
    found = base_spans(docs, keep_text=True)
    pieces = stored(
        found.select(
            "doc_id",
            "text_key",
            "base",
            F.when(F.size("base") > 0, F.col("text")).alias("text"),
        ),
        "personal",
    )
    terms = stored(disclosing(docs, pieces, rules), "personal-terms")
    per_doc = term_spans(docs, terms)
    key = pieces["doc_id"].eqNullSafe(per_doc["doc_id"]) & (pieces["text_key"] == per_doc["text_key"])
    joined = pieces.join(per_doc, key, "left").select(
        pieces["doc_id"], pieces["text_key"], "base", F.coalesce("marked", no_spans()).alias("marked")
    )
    apart = F.filter(
        "marked", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )
    return joined.select("doc_id", "text_key", "base", apart.alias("terms"))


def personal_data(docs: DataFrame, rules: DisclosureRules = DisclosureRules()) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    return personal_spans(docs, rules).select(
        "doc_id",
        *[count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "terms"))).alias("spans"),
    )


def _joined(base: Column) -> Column:
    """Overlapping spans become one, named after the first; the rest stay in order."""
    start = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        wider = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind")
        )
        overlaps = F.coalesce(last["end"] > s["start"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(own))
        )

    return F.aggregate(base, start, add)


def sanitise(docs: DataFrame, rules: DisclosureRules = DisclosureRules()) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all columns stay."""
    names = docs.columns
    marks = personal_spans(docs, rules).where((F.size("base") > 0) | (F.size("terms") > 0))
    marks = marks.select(
        F.col("doc_id").alias("_mark_id"),
        F.col("text_key").alias("_mark_key"),
        _joined(F.array_sort(F.concat("base", "terms"))).alias("_marks"),
    ).dropDuplicates(["_mark_id", "_mark_key"])
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id").eqNullSafe(F.col("_mark_id")) & (F.xxhash64(text) == F.col("_mark_key"))
    df = docs.join(marks, key, "left")
    before = F.transform(
        "_marks",
        lambda s, i: F.concat(
            F.substring(
                F.col("text"),
                (F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("_marks", i - 1)["end"]) + 1).cast("int"),
                (
                    s["start"] - F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("_marks", i - 1)["end"])
                ).cast("int"),
            ),
            F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")),
        ),
    )
    after = F.substring(F.col("text"), (F.element_at("_marks", -1)["end"] + 1).cast("int"), F.length("text"))
    clean = F.when(F.col("_marks").isNotNull(), F.concat(F.array_join(before, ""), after)).otherwise(F.col("text"))
    df = df.withColumn("_clean", clean)
    values = {"text": F.col("_clean")}
    if "n_chars" in names:
        values["n_chars"] = F.when(F.col("_marks").isNotNull(), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.select(*[values.get(c, F.col(c)).alias(c) for c in names])
