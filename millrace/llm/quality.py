"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BoundedCache, cache_of, map_texts, written

ASCII_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1) | 1 for i in range(8)], dtype=np.uint64)

_word_hash = cache_of("quality", "words", BoundedCache(lambda w: xxhash.xxh64_intdigest(w), 48))
_token_hashes = cache_of("quality", "tokens", BoundedCache(lambda w: _hashes_of(w), 48))


def _hashes_of(word: bytes) -> bytes:
    """Hashes of a word's tokens, in lower case."""
    tokens = _TOKEN.findall(word.decode("utf-8").lower())
    return np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64).tobytes()


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text and its ASCII-space separated words."""
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside a window of ``width`` words that occurs at least twice in the text.

    Windows are compared by a 64-bit hash of their words.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows += hashes[i : i + n] * _ODD[i]
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[width:] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def ngram_buckets(words: list[bytes], bits: int) -> np.ndarray:
    """Bucket numbers of a text's tokens and adjacent token pairs (lower case, words and punctuation apart)."""
    tokens = np.frombuffer(b"".join(map(_token_hashes.__getitem__, words)), np.uint64)
    pairs = (tokens[:-1] * _ODD[0] + tokens[1:] * _ODD[1]) * _ODD[2]
    return (np.concatenate([tokens * _ODD[3], pairs]) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class QualityModel:
    """Log ratios by bucket, and the least mean ratio of a kept text."""

    log_ratio: np.ndarray
    bits: int
    prior: float
    threshold: float = -np.inf

    def score(self, words: list[bytes]) -> float:
        """Mean log ratio over the text's n-grams, ``prior`` neutral ones added; 0 for a text without any."""
        buckets = ngram_buckets(words, self.bits)
        return float(self.log_ratio[buckets].sum() / (len(buckets) + self.prior))


def trusted_sample(labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """Ids of all rows labelled quality 1, or of the ``max_trusted`` of least hash."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return ids if max_trusted is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def with_fifths(docs: DataFrame, sample: DataFrame, bits: int = 26) -> DataFrame:
    """``(fifth, text)`` of every row of ``docs``; ``fifth`` is that of its id in ``sample``, null where it is not there.

    A bitmap of the sample's hashed ids, of at most 2^``bits`` bits in rows of 4 KB (8 MB), is sent to the scan. Rows whose
    bit is not set cannot be in the sample and stay where they are; the others are joined exactly.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)) + 1
    set_bits = sample.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")).distinct()
    bitmap = set_bits.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    asked = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place))
    tested = asked.join(F.broadcast(written(bitmap, "bitmap")), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    likely_rows = tested.where(likely).select("doc_id", "text").join(sample.hint("merge"), "doc_id", "left")
    other = tested.where(~likely).select(F.lit(None).cast("long").alias("fifth"), "text")
    return other.unionByName(likely_rows.select("fifth", "text"))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 16,
    max_trusted: int | None = None,
    quantile: float = 0.002,
    slack: float = 0.03,
    prior: float = 20.0,
) -> QualityModel:
    """Fit the two multinomials and the threshold.

    The raw multinomial counts every text of ``docs``; the trusted one counts the texts of all rows labelled quality 1
    (of ``max_trusted`` of them where that is given), but for every fifth of them. Only texts that may be labelled are
    shuffled to meet their labels (:func:`with_fifths`). Both counts are made in one pass: each task adds up its own buckets
    and emits at most 2^``bits`` rows, which a pre-aggregated sum joins; 2^``bits`` sums come to the driver. The pass also
    writes the texts of those left out, and the threshold is the ``quantile`` of their scores, less ``slack``, so nearly all
    text like them stays. Without trusted rows all ratios are 0 and only the base rules decide.
    """
    sample = trusted_sample(labels, max_trusted).withColumn("fifth", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    marked = with_fifths(docs.select("doc_id", "text"), sample)

    def count(batches: Iterator) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), np.int64)
        for fifths, texts in batches:
            apart = []
            for fifth, text in zip(fifths.to_pylist(), texts, strict=True):
                buckets = ngram_buckets((text or "").encode("utf-8").split(), bits)
                found = np.bincount(buckets, minlength=1 << bits) if len(buckets) > 20_000 else None
                for row in (0, 1) if fifth else (0,):
                    if found is not None:
                        totals[row] += found
                    else:
                        np.add.at(totals[row], buckets, 1)
                if fifth == 0:
                    apart.append(text)
            n = len(apart)
            yield _counted(n, [pa.nulls(n, pa.int64())] * 3, apart)
        some = np.flatnonzero(totals[0])
        yield _counted(len(some), [pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])], [None] * len(some))

    parts = written(map_texts(marked, count, "bucket long, raw long, target long, apart string", "fifth", uses="quality"), "counts")
    rows = parts.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(1 << bits), np.ones(1 << bits)
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == len(target):
        return QualityModel(np.zeros(1 << bits), bits, prior)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    model = QualityModel(ratio, bits, prior)
    apart = parts.where("bucket IS NULL").select(F.lit(0).cast("long").alias("doc_id"), F.col("apart").alias("text"))
    scores = score_quality(apart, model).where("not base_failed").select("score")
    found = lower_quantile(written(scores, "scores"), "score", quantile)
    model.threshold = found - slack if found is not None else -np.inf
    return model


def _counted(n: int, counts: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
    columns = [pa.nulls(n, pa.int64()), *counts, pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["key", "bucket", "raw", "target", "apart"])


def lower_quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, interpolated, of a small ``share``, from the values up to it alone; null without values."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    place = share * (n - 1)
    low, high = int(np.floor(place)), int(np.ceil(place))
    last = rows.where(F.col(column).isNotNull()).orderBy(column).limit(high + 1).orderBy(F.desc(column)).limit(high - low + 1).collect()
    return last[-1][0] + (last[0][0] - last[-1][0]) * (place - low)


def score_quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", carry_row: bool = False
) -> DataFrame:
    """``(doc_id, <base counts>, score, base_failed, kept)`` of every whole text; one narrow map, no shuffle.

    A text is kept if the base rules pass (20 words or more, at most 30 % of them in repeated windows) and its
    score reaches the model's threshold. Null and empty texts have zero counts, score 0 and fail the base rules.
    Null ids and repeated rows give one row each. With ``carry_row`` the first column is ``row``, the whole input
    row as a struct, in place of the id.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for keys, texts in batches:
            counts, scores = [], []
            for text in texts:
                words = (text or "").encode("utf-8").split()
                counts.append(base_counts(text or "", words))
                scores.append(fitted.score(words))
            columns = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * 5)]
            names = [c.split()[0] for c in BASE.split(", ")]
            yield pa.RecordBatch.from_arrays([keys, *columns, pa.array(scores)], ["key", *names, "score"])

    out = map_texts(docs, run, f"{BASE}, score double", id_col, text_col, carry_row, "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(_threshold(model))))
    return out.withColumnRenamed("key", "row" if carry_row else id_col)


def _threshold(model) -> float:
    return float(model.value.threshold)
