"""SentencePiece encoding and decoding through a table of distinct marked words."""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BoundedTable, cache_of, map_texts

MARK = "▁"


class ChunkTable:
    """Segments each distinct marked word once and joins ids back by position.

    The marker may only stand at the front of a piece, so a word with the markers before it is segmented alike in any
    surroundings. ``__init__`` checks this on the vocabulary and normalizer, and the library gets whole texts where
    it fails; likewise for the rare texts that hold the marker character itself. The table's memory is bounded; when
    full it keeps the words of the present slice, which changes no result.
    """

    def __init__(self, model_path: str, megabytes: float = 64):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self._keeps_spaces()
        self.table: BoundedTable = cache_of("pieces", f"ids {model_path}", BoundedTable(megabytes))
        # Decoded forms of those of the table's words that decode to another text.
        self.changed: dict[str, str] = cache_of("pieces", f"changed {model_path}", {})

    def _keeps_spaces(self) -> bool:
        """Whether the model's normalizer is the identity but for one marker put in front."""
        sample = "  a  éﬁ 　b\t\n "
        return self.model.normalize(sample) == MARK + sample.replace(" ", MARK)

    def _add(self, missing: list[str], used: set[str]) -> None:
        """Segment words that the table lacks; the library puts one marker in front of what it gets."""
        fresh, changed = {}, {}
        plain = [word.replace(MARK, " ") for word in missing]
        found = self.model.encode(plain, num_threads=1)
        decoded = self.model.decode(found, num_threads=1)
        for word, spaced, ids, text in zip(missing, plain, found, decoded, strict=True):
            if not word:  # a marker alone, which the library would not put before nothing
                ids, text = [self.model.piece_to_id(MARK)], ""
            fresh[word] = array("i", ids).tobytes()
            if text != spaced:
                changed[word] = text
        self.table.add(fresh, lambda: used)
        self.changed.update(changed)
        for word in self.changed.keys() - self.table.keys():  # what the table gave up
            del self.changed[word]

    @staticmethod
    def words(text: str) -> list[str]:
        """The text cut before every run of spaces; of each run all but one marker stay on the word."""
        words = text.split(" ")
        if "" not in words:
            return words
        out, extra = [], 0
        for w in words[:-1]:
            if w:
                out.append(MARK * extra + w)
                extra = 0
            else:
                extra += 1
        out.append(MARK * extra + words[-1])
        return out

    def convert(self, texts: list[str], decode: bool) -> tuple[list[bytes], list[str | None]]:
        """Each text's ids as little-endian 32-bit integers, and what the library's decode(ids) gives."""
        ids: list = [b""] * len(texts)
        decoded: list = ["" if decode else None] * len(texts)
        words = {}
        for i, text in enumerate(texts):
            if text and (MARK in text or not self.splits):
                found = self.model.encode(text)
                ids[i] = array("i", found).tobytes()
                decoded[i] = self.model.decode(found) if decode else None
            elif text:
                words[i] = self.words(text)
        used = set().union(*words.values())
        missing = used - self.table.keys()
        if missing:
            self._add(sorted(missing), used)
        for i, found in words.items():
            ids[i] = b"".join(map(self.table.__getitem__, found))
            if decode and self.changed:
                decoded[i] = " ".join([self.changed.get(w, w.replace(MARK, " ")) for w in found])
            elif decode:
                decoded[i] = texts[i]
        return ids, decoded


_TABLES: dict[str, ChunkTable] = {}


def _table(path: str) -> ChunkTable:
    return _TABLES.get(path) or _TABLES.setdefault(path, ChunkTable(path))


def encode_pieces(
    docs: DataFrame, model_path: str, decode: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` of every text, as the sentencepiece library would give them.

    ``model_path`` must be readable on every worker. Per worker a bounded table holds each distinct marked word's
    ids and decoded form; a text is the concatenation of its words' entries in order of position. Null texts count
    as empty (no ids, empty decoded text); repeated rows and null ids are kept. One narrow map, no shuffle, and
    a worker holds one slice of a batch besides its table.
    """

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for keys, texts in batches:
            texts = [t or "" for t in texts]
            ids, decoded = table.convert(texts, decode)
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) // 4 for i in ids], out=ends[1:])
            flat = np.frombuffer(b"".join(ids), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([keys, lists, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    out = map_texts(docs, run, "ids array<int>, decoded string", id_col, text_col, uses="pieces")
    return out.withColumnRenamed("key", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` for any table of id arrays; null arrays decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _table(model_path).model
        for batch in batches:
            decoded = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], ["key", "decoded"])

    rows = encoded.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{ids_col}`").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", id_col)
