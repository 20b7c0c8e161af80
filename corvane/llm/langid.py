"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (one to three characters, lower-cased) that both have, over the root of the product of
their numbers of n-grams: a blended-spectrum presence kernel. An n-gram is known by a hash of SPACE values, so two that share a value count as one. Landmarks
chosen from the labelled sample give a Nyström approximation;
kernel ridge regression, one language against the rest, is fitted on it. A batch of texts is scored by two matrix products: presence of the
landmarks' n-grams times the landmarks, then times the coefficients.

The model is fitted on a bounded sample of the labelled texts: of each of the ``LANGUAGES`` most frequent languages the first
``PER_LANGUAGE`` texts by a hash of doc_id and text, as long as they are within ``SAMPLE_BYTES`` together, those of up to ``TEXT_BYTES`` before longer ones.
Texts to predict are read whole, and only their text is used.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a text none of whose n-grams any landmark has gets the language with
the largest intercept; languages that are null aren't learned, nor those whose every text is beyond SAMPLE_BYTES; with no labelled text every text is
``und``. Rows with one doc_id, or a null one, each give a row, and repeated rows count once in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches

ORDERS = (1, 2, 3)
PER_LANGUAGE = 400
LANGUAGES = 200
TEXT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LANDMARKS = 48  # for each language
RIDGE = 1e-3
SPACE = 1 << 18
BATCH = 256
PIECE = 1 << 20


def _codes(text: str) -> np.ndarray:
    """n-grams of a text as distinct hashes below SPACE, in order; runs of other characters than letters are one blank."""
    there = np.zeros(SPACE, bool)
    text = text.lower()
    for at in range(0, len(text), PIECE):  # pieces overlap by an n-gram less one
        points = np.frombuffer(text[max(0, at - max(ORDERS) + 1) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in ORDERS:
            if len(points) < n:
                break
            h = np.full(len(points) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            there[h & np.uint32(SPACE - 1)] = True
    return np.flatnonzero(there)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # the column of each hash that some landmark has, else -1
    landmarks: np.ndarray  # columns by landmarks, normalised
    weights: np.ndarray  # landmarks and an intercept by languages

    def kernel(self, codes: list[np.ndarray]) -> np.ndarray:
        presence = np.zeros((len(codes), self.landmarks.shape[0]), np.float32)
        for row, c in enumerate(codes):
            at = self.column[c]
            presence[row, at[at >= 0]] = 1 / np.sqrt(max(1, len(c)))
        return presence @ self.landmarks

    def scores(self, texts: list[str]) -> np.ndarray:
        k = self.kernel([_codes(t) for t in texts])
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights


def train(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    names = sorted(set(languages))
    if not names:
        return None
    codes = [_codes(t) for t in texts]
    chosen = [i for name in names for i in [j for j, x in enumerate(languages) if x == name][:landmarks]]
    known = np.unique(np.concatenate([codes[i] for i in chosen]))
    column = np.full(SPACE, -1, np.int32)
    column[known] = np.arange(len(known))
    marks = np.zeros((len(known), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[column[codes[i]], j] = 1 / np.sqrt(max(1, len(codes[i])))
    model = Model(names, column, marks, np.zeros((len(chosen) + 1, len(names)), np.float32))
    among = (marks.T @ marks).astype(float)
    values, vectors = np.linalg.eigh(among)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([np.vstack([model.kernel(codes[a : a + BATCH]) for a in range(0, len(codes), BATCH)]) @ root, np.ones((len(codes), 1))])
    target = np.array([[1.0 if x == name else -1.0 for name in names] for x in languages])
    share = np.array([languages.count(x) for x in languages], float)  # each language weighs the same
    w = (len(languages) / share)[:, None]
    penalty = ridge * len(codes) * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(features.T @ (w * features) + penalty, features.T @ (w * target))
    model.weights = np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)
    return model


def held_out(id_col: Column) -> Column:
    """Every fifth document by the crc32 of its id's text; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang and text of the labelled rows to learn from; at most LANGUAGES times ``per_language`` rows and SAMPLE_BYTES."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = named.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id", "text")
    counts = labelled.groupBy("lang").agg(F.greatest(F.lit(1), F.approx_count_distinct(key)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    million = 1_000_000
    shares = counts.select(F.col("lang").alias("of"), F.least(F.lit(million), F.ceil(F.lit(3 * per_language * million) / F.col("n"))).alias("share"))
    few = labelled.join(F.broadcast(shares), F.col("lang") == F.col("of")).withColumn("key", key).filter(F.pmod("key", F.lit(million)) < F.col("share"))
    few = few.select("lang", "key", F.octet_length("text").alias("bytes"), "text").dropDuplicates(["lang", "key"])
    order = Window.partitionBy("lang").orderBy(F.col("bytes") > TEXT_BYTES, "key")
    ranked = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    return ranked.withColumn("upto", F.sum("bytes").over(Window.partitionBy("lang").orderBy("rank"))).filter(F.col("upto") <= SAMPLE_BYTES).select("lang", "rank", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    rows = sorted(sample(docs, per_language).collect(), key=lambda r: (r.lang, r["rank"]))
    return train([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PER_LANGUAGE and LANDMARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            there = [i for i, t in enumerate(texts) if own and t and _has_letter(t)]
            for a in range(0, len(there), BATCH):
                part = there[a : a + BATCH]
                s = own.scores([texts[i] for i in part])
                p = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                for i, best, row in zip(part, s.argmax(axis=1).tolist(), p, strict=True):
                    names[i], scores[i] = own.languages[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    bound_batches(docs.sparkSession)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return raw.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
