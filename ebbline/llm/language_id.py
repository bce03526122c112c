"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text with all
other characters as blanks, weighted by TF-IDF and brought to length one. The
document frequencies come from every training document. The regression is
fitted by follow-the-regularised-leader with elastic-net penalties on a sample
of ``sample_rows`` training documents, drawn by a hash evenly over the
languages; a part of the sample is left out and sets the temperature of the
probabilities. Whole texts are used throughout.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text where there is nothing to learn from. Null labels are not learned.
A null ``doc_id`` is not held out and not learned from. Repeated rows get equal
results; other columns than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.worker import give_back, task_of, within

UNKNOWN = "und"
PREDICTION = "lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the rows of the fit; everything else covers all documents."""

    sample_rows: int = 6000
    bits: int = 14
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    bits: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def counts_of(text: str, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the whole text and how often each occurs; None where it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    if not len(codes):
        return None
    low = codes < 0x10000
    letter = _letters()[np.where(low, codes, 0)]
    for i in np.flatnonzero(~low):
        letter[i] = chr(codes[i]).isalpha()
    if not letter.any():
        return None
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint32)
    shift = np.uint32(32 - bits)
    pairs = codes[:-1] * np.uint32(0x01000193) + codes[1:]
    triples = pairs[:-1] * np.uint32(0x01000193) + codes[2:]
    hashed = [
        ((grams ^ np.uint32(salt)) * np.uint32(0x9E3779B1)) >> shift
        for grams, salt in ((codes, 0x51ED27), (pairs, 0x2545F4), (triples, 0x1B8735))
    ]
    found = np.bincount(np.concatenate(hashed), minlength=1 << bits)
    places = np.flatnonzero(found)
    return places, found[places]


def _weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    places, counts = found
    values = (1 + np.log(counts)) * idf[places]
    return values / max(np.linalg.norm(values), 1e-12)


def held_out() -> Column:
    """True where the contract keeps a document out of training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    learned = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    return docs.select("doc_id", "text", "lang").where(learned)


def _document_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                found = counts_of(text.as_py(), bits)
                if found is not None:
                    total[found[0]] += 1
                    total[-1] += 1
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total[places])], ["place", "n"])

    return run


def _sample_features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(text.as_py(), bits) for text in batch["text"]]
            keep = [i for i, x in enumerate(found) if x is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(keep, pa.int32())).cast(pa.int64()),
                    batch["lang"].take(pa.array(keep, pa.int32())),
                    pa.array([found[i][0].astype("<i4").tobytes() for i in keep], pa.binary()),
                    pa.array([found[i][1].astype("<i4").tobytes() for i in keep], pa.binary()),
                ],
                ["doc_id", "lang", "places", "counts"],
            )

    return run


def _fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, settings: Settings
) -> np.ndarray:
    """Weights per feature and class; the last feature is the constant."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        pulled = np.sign(z[at]) * settings.l1 - z[at]
        scale = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(z[at]) <= settings.l1, 0.0, pulled / scale)

    order = np.random.default_rng(3)
    for _ in range(settings.epochs):
        for i in order.permutation(len(rows)):
            places, values, label = rows[i]
            at, x = np.append(places, size), np.append(values, 1.0)
            w = weights(at)
            scores = x @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            gradient = x[:, None] * p
            squares = gradient * gradient
            sigma = (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - sigma * w
            n[at] += squares
    return weights(np.arange(size + 1))


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that were not fitted."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def train(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """The fitted model; None where no document can be learned from."""
    rows = training_rows(docs)
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_language:
        return None
    quota = settings.sample_rows / len(per_language)
    draw = (F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for language, n in per_language.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, quota / n))).otherwise(share)
    counts = rows.select("text").mapInArrow(within("language_id", _document_counts(settings.bits)), "place int, n bigint")
    counted = counts.groupBy("place").agg(F.sum("n").alias("n")).collect()
    size = 1 << settings.bits
    frequency = np.zeros(size + 1)
    for r in counted:
        frequency[r["place"]] = r["n"]
    if not frequency[-1]:
        return None
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    sample = (
        rows.where(draw < share)
        .mapInArrow(within("language_id", _sample_features(settings.bits)), "doc_id bigint, lang string, places binary, counts binary")
        .toPandas()
        .sort_values(["doc_id", "lang", "places"])
    )
    languages = tuple(sorted(sample["lang"].unique()))
    if not languages:
        return None
    data = []
    for r in sample.itertuples():
        found = np.frombuffer(r.places, "<i4"), np.frombuffer(r.counts, "<i4")
        data.append((found[0], _weighted(found, idf), languages.index(r.lang)))
    left_out = data[::6] if len(data) >= 12 else []
    fitted = [row for i, row in enumerate(data) if i % 6 or not left_out]
    weights = _fit(fitted, size, len(languages), settings)
    scores = np.array([values @ weights[places] + weights[-1] for places, values, _ in left_out])
    labels = np.array([label for _, _, label in left_out])
    return Model(languages, idf, weights, _temperature(scores, labels), settings.bits)


def predictor(docs: DataFrame, model: Model | None):
    """A column function from text to prediction; the model is a table of fixed size and sent once."""
    # What the fit took on the driver is free by now; later stages of a pipeline should find it so.
    give_back()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(own: Model | None, texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for text in texts:
            found = counts_of(text, own.bits) if own is not None and text is not None else None
            if found is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            s = (_weighted(found, own.idf) @ own.weights[found[0]] + own.weights[-1]) / own.temperature
            p = np.exp(s - s.max())
            best = int(np.argmax(p))
            names.append(own.languages[best])
            scores.append(float(p[best] / p.sum()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with task_of("language_id"):
            for texts in batches:
                yield predicted(sent.value, texts)

    return predict


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Predicted language and calibrated probability of every document."""
    predict = predictor(docs, train(docs, settings))
    rows = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, settings: Settings = Settings(), least: float = 0.35) -> DataFrame:
    """The documents whose language is known with at least that probability, with all their columns."""
    predict = predictor(docs, train(docs, settings))
    names = docs.columns
    marked = docs.withColumn("_language", predict(F.col("text")))
    kept = (F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= least)
    return marked.where(kept).select(*names)
