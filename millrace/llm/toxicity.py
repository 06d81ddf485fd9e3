"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BoundedCache, map_texts

_ENDS = ".!?\n"
_SENTENCE = re.compile(f"[^{_ENDS}]+")
_EDGES = ".,;:!?\"'()[]{}*&$%#|<>«»"


def features_of(token: str) -> tuple[int, ...]:
    """31-bit hashes of a token's word (lower case, no punctuation at its ends) and of the word's openings.

    Openings of three to six letters tie words of one stem together. Punctuation alone has no features.
    """
    word = token.strip(_EDGES).lower()
    names = [word, *[f"{word[:n]}-" for n in range(3, min(6, len(word)) + 1)]] if word else []
    return tuple((xxhash.xxh64_intdigest(name.encode("utf-8")) & 0x7FFFFFFF) for name in names)


@dataclass
class ToxicityModel:
    """Weights of hashed words, and the bias of every sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self):
        """A function from tokens to the sums of their features' weights."""
        weights = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))
        return lambda token: sum(weights.get(f, 0.0) for f in features_of(token))


def training_sample(labels: DataFrame, max_docs: int) -> DataFrame:
    """Ids and labels of at most ``max_docs`` labelled rows outside the held-out quarter, those of least hash.

    A document with several labels counts as toxic if one of them says so.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    return (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )


def held_out(doc_id):
    """Whether crc32 of the id, as text, leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_docs: int = 6_000, min_docs: int = 4, rounds: int = 100, l1: float = 5e-4
) -> ToxicityModel:
    """Train on the texts of at most ``max_docs`` labelled rows (:func:`training_sample`).

    Tasks hash the sampled texts' words by sentence; the hashes (not the texts) of this bounded sample come to the
    driver, which climbs the likelihood of the document labels under ``p = 1 - prod(1 - sigmoid(w . x + b))`` over
    sentences. Features in fewer than ``min_docs`` sampled documents have no weight. Without labelled rows the model
    has no words and a bias under which every text scores near 0.
    """
    sample = training_sample(labels, max_docs)
    # Bounded by max_docs rows, whatever the size of labels.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        hashed = BoundedCache(features_of, 24)
        for toxic, texts in batches:
            words, ends = [], []
            for text in texts:
                sentences = [{f for t in {*s.split()} for f in hashed[t]} for s in _SENTENCE.findall(text or "")]
                words.append(np.array([f for s in sentences for f in s], np.int32).tobytes())
                ends.append(np.array([len(s) for s in sentences], np.int32).tobytes())
            columns = [toxic, pa.array(words, pa.binary()), pa.array(ends, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "features", "sizes"])

    rows = map_texts(chosen, run, "features binary, sizes binary", "toxic").toArrow()
    toxic = rows.column("key").to_numpy().astype(np.float64)
    if not toxic.any():
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -9.0)
    features = [np.frombuffer(f.as_buffer(), np.int32) for f in rows.column("features")]
    sizes = [np.frombuffer(s.as_buffer(), np.int32) for s in rows.column("sizes")]
    return _climb(features, [s[s > 0] for s in sizes], toxic, min_docs, rounds, l1)


def _climb(features, sizes, labels, min_docs, rounds, l1) -> ToxicityModel:
    """Full-batch Adam on the noisy-or likelihood, with a soft threshold that keeps most weights at 0."""
    some = [i for i, s in enumerate(sizes) if len(s)]
    features, sizes, labels = [features[i] for i in some], [sizes[i] for i in some], labels[some]
    vocabulary, seen = np.unique(np.concatenate([np.unique(f) for f in features]), return_counts=True)
    vocabulary = vocabulary[seen >= min_docs]
    places, sentences, n_sentences = [], [], 0
    for flat, own in zip(features, sizes, strict=True):  # 32-bit numbers of the features that stay, text by text
        at = np.searchsorted(vocabulary, flat)
        known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == flat if len(vocabulary) else np.zeros(len(flat), bool)
        places.append(at[known].astype(np.int32))
        sentences.append(np.repeat(np.arange(n_sentences, n_sentences + len(own), dtype=np.int32), own)[known])
        n_sentences += len(own)
    where, sentence = np.concatenate(places), np.concatenate(sentences)
    del places, sentences, features
    first = np.concatenate([[0], np.cumsum([*map(len, sizes)])[:-1]])
    doc_of = np.repeat(np.arange(len(sizes)), [*map(len, sizes)])
    w, b = np.zeros(len(vocabulary)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[where], n_sentences)
        p = 1 / (1 + np.exp(-z))
        log_clean = np.add.reduceat(-np.logaddexp(0, z), first)  # log prod(1 - p)
        clean = np.exp(log_clean)
        # d loss / d z of a sentence: p for a clean document, -p * clean / (1 - clean) for a toxic one.
        push = np.where(labels > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g = p * push[doc_of] / len(sizes)
        grad = np.append(np.bincount(where, g[sentence], len(w)), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        rate = 0.15 / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        moved = np.append(w, b) - rate * m / (1 - 0.9**step)
        w, b = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate[:-1] * l1, 0), moved[-1]
    keep = np.abs(w) > 1e-3
    return ToxicityModel(vocabulary[keep].astype(np.int64), w[keep], float(b))


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry_row: bool = False,
) -> DataFrame:
    """``(doc_id, score, predicted, offending)`` of every whole text; one narrow map, no shuffle.

    ``score`` is the noisy-or of the sentence scores; ``offending`` lists the sentences that score at least
    ``threshold`` as (start, end, score), in code points, end exclusive, for texts with ``predicted`` 1. Null and
    empty texts score 0. Null ids and repeated rows give one row each. ``carry_row``: see
    :func:`millrace.llm.quality.score_quality`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = "array<struct<start:int,end:int,score:double>>"

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        weight = BoundedCache(fitted.lookup(), 48)
        bias = fitted.bias

        def logit(sentence: str) -> float:
            return bias + sum(map(weight.__getitem__, {*sentence.split()}))

        for keys, texts in batches:
            scores, offending = [], []
            for text in texts:
                text = text or ""
                sentences = [s for s in _SENTENCE.findall(text) if not s.isspace()]
                whole = text
                for mark in _ENDS:
                    whole = whole.replace(mark, " ")
                if any(map(weight.__getitem__, {*whole.split()})):
                    z = np.array([logit(s) for s in sentences])
                else:  # none of the sentences' tokens has a weight, so all of them score alike
                    z = np.full(len(sentences), bias)
                score = float(-np.expm1(-np.logaddexp(0, z).sum()))
                scores.append(score)
                found = []
                if score >= threshold:
                    for s in _SENTENCE.finditer(text):
                        p = 1 / (1 + np.exp(-logit(s[0])))
                        if p >= threshold:
                            found.append({"start": s.start(), "end": s.end(), "score": float(p)})
                offending.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(scores, pa.float64()), pa.array(offending, kind)], ["key", "score", "offending"]
            )

    out = map_texts(docs, run, f"score double, offending {spans}", id_col, text_col, carry_row)
    out = out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return out.withColumnRenamed("key", "row" if carry_row else id_col)
