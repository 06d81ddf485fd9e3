"""Language identification by hyperdimensional profiles."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import map_texts

_NOT_LETTERS = regex.compile(r"\P{L}+")
_BITS = 21  # code points need no more


class Profiles:
    """Vectors of letters, n-grams and texts.

    Every letter has a random vector of +1 and -1, made from its code point. An n-gram binds (multiplies) its
    letters' vectors, each permuted (rotated) once more than the next; a text bundles (adds) the vectors of its
    n-grams. The n-gram vectors are kept in a bounded table.
    """

    def __init__(self, dims: int = 1024, seed: int = 11, limit: int = 16_384):
        self.dims, self.seed, self.limit = dims, seed, limit
        self.letters: dict[int, np.ndarray] = {}
        self.known = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.table = np.zeros((limit, dims), np.float32)
        self.used = 0

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            rng = np.random.default_rng([self.seed, point])
            self.letters[point] = rng.integers(0, 2, self.dims, np.int8) * np.int8(2) - np.int8(1)
        return self.letters[point]

    def ngram(self, code: int) -> np.ndarray:
        mask = (1 << _BITS) - 1
        a, b, c = code >> 2 * _BITS, code >> _BITS & mask, code & mask
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def codes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct triples of a text's letters (Unicode's L, in lower case; all else as one blank) and their counts."""
        letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
        if not letters:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        triples = points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:]
        return np.unique(triples, return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers in the table for sorted distinct codes, at most ``limit`` of them."""
        at = np.searchsorted(self.known, codes)
        at[at == len(self.known)] = 0
        missing = codes[self.known[at] != codes] if len(self.known) else codes
        if self.used + len(missing) > self.limit:
            self.known, self.rows, self.used, missing = codes[:0], self.rows[:0], 0, codes
        if len(missing):
            for code in missing.tolist():
                self.table[self.used] = self.ngram(code)
                self.used += 1
            fresh = np.arange(self.used - len(missing), self.used)
            known, rows = np.concatenate([self.known, missing]), np.concatenate([self.rows, fresh])
            order = np.argsort(known)
            self.known, self.rows = known[order], rows[order]
        return self.rows[np.searchsorted(self.known, codes)]

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One bundled vector for each text."""
        out = np.zeros((len(counted), self.dims), np.float32)
        for start in range(0, len(counted), 32):
            part = counted[start : start + 32]
            codes = np.unique(np.concatenate([c for c, _ in part]))
            for low in range(0, len(codes), self.limit):
                block = codes[low : low + self.limit]
                counts = np.zeros((len(part), len(block)), np.float32)
                for i, (c, n) in enumerate(part):
                    at = np.searchsorted(block, c)
                    here = (at < len(block)) & (block[np.minimum(at, len(block) - 1)] == c)
                    counts[i, at[here]] = n[here]
                out[start : start + len(part)] += counts @ self.table[self.vectors(block)]
        return out


@dataclass
class LanguageModel:
    """One unit prototype vector for each language, in order of name."""

    names: list[str]
    prototypes: np.ndarray


_PROFILES: list[Profiles] = []


def _profiles() -> Profiles:
    if not _PROFILES:
        _PROFILES.append(Profiles())
    return _PROFILES[0]


def held_out(doc_id):
    """Whether crc32 of the id, as text, leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_languages(docs: DataFrame, max_docs: int = 20_000, max_languages: int = 1024) -> LanguageModel:
    """Bundle the texts of each language into a prototype.

    Learns from rows that are not held out and whose lang is not null; about ``max_docs`` of them at most, chosen
    by a hash of the id (each row's chance is ``max_docs`` over their number). Of their languages the ``max_languages`` that
    most of them have are learned (ties by name), so that dirty names cannot swell the model. Every task emits one
    partial bundle for each of its languages, which one aggregate adds up by dimension.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    share = int(min(1.0, max_docs / max(n, 1)) * 2**20)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < share).select("lang", "text")
    known = chosen.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    chosen = chosen.where(F.col("lang").isin([r.lang for r in known]))

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        profiles, sums = _profiles(), {}
        for langs, texts in batches:
            vectors = profiles.bundle([profiles.codes(t) for t in texts])
            for lang, vector in zip(langs.to_pylist(), vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        names = [lang for lang in sums for _ in range(profiles.dims)]
        dims = [*range(profiles.dims)] * len(sums)
        values = np.concatenate([*sums.values()]) if sums else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(dims, pa.int32()), pa.array(values)], ["key", "dim", "value"]
        )

    parts = map_texts(chosen, run, "dim int, value double", "lang")
    rows = parts.groupBy("key", "dim").agg(F.sum("value").alias("value")).collect()
    names = sorted({r.key for r in rows})
    prototypes = np.zeros((len(names), _profiles().dims))
    for r in rows:
        prototypes[names.index(r.key), r.dim] = r.value
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel(names, prototypes / np.maximum(norms, 1e-12))


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text: the prototype of greatest cosine, and that cosine.

    Ties go to the first name in order. Texts that are null or have no letter get ``und`` with score 0, and so do
    all texts if no language was learned. Null ids and repeated rows give one row each. One narrow map, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        fitted, profiles = shared.value, _profiles()
        for keys, texts in batches:
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            counted = [profiles.codes(t) for t in texts]
            some = [i for i, (c, _) in enumerate(counted) if len(c) and fitted.names]
            if some:
                vectors = profiles.bundle([counted[i] for i in some]).astype(np.float64)
                cosine = vectors @ fitted.prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                for i, row in zip(some, cosine, strict=True):
                    names[i] = fitted.names[int(row.argmax())]
                    scores[i] = float(min(max(row.max(), 0.0), 1.0))
            yield pa.RecordBatch.from_arrays([keys, pa.array(names), pa.array(scores)], ["key", "lang_pred", "score"])

    out = map_texts(docs, run, "lang_pred string, score double", id_col, text_col)
    return out.withColumnRenamed("key", id_col)
