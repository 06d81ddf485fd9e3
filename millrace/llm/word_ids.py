"""Ids of the tokenizers library, looked up once for each distinct white-space separated word."""

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from millrace.llm.shared import BoundedTable, cache_of

MARK = "([a-zß-öø-ÿ])([.,;:!?*&$%#])"
COMBINING = "[\u0300-\u037f]"


class WordIds:
    """Encodes texts as the library does (no special tokens added), with each distinct word encoded once.

    Holds for tokenizers that neither keep white space nor join characters across it; ``__init__`` checks this by
    comparison on a sample, and whole texts go to the library where it fails. The table's memory is bounded. Texts are cut,
    and the distinct words of a slice found, in Arrow; only these are looked up, and ids are put in place by number.
    """

    _loaded: dict[str, "WordIds"] = {}

    def __init__(self, path: str, megabytes: float = 140):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.table: BoundedTable = cache_of("word_ids", path, BoundedTable(megabytes))
        sample = "Un mot, deux\tmots\n\n 12 é's e ́ <|endoftext|>x ende"
        whole = self.library.encode(sample, add_special_tokens=False).ids
        self.by_word = whole == [i for w in sample.split() for i in self.library.encode(w, add_special_tokens=False).ids]

    @classmethod
    def load(cls, path: str) -> "WordIds":
        return cls._loaded.get(path) or cls._loaded.setdefault(path, cls(path))

    @property
    def vocabulary_size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Words are cut at the ASCII white space only; any other stays inside a word and the library sees it.
        """
        if not self.by_word:
            found = self.library.encode_batch_fast(texts, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        lists = pc.ascii_split_whitespace(self._plain(pa.array(texts, pa.large_string())))
        words = lists.flatten().dictionary_encode()
        distinct = self._strings(words.dictionary)
        found = [*map(self.table.get, distinct)]
        fresh = [i for i, ids in enumerate(found) if ids is None]
        if fresh:
            coded = self.library.encode_batch_fast([distinct[i].decode("utf-8") for i in fresh], add_special_tokens=False)
            for i, e in zip(fresh, coded, strict=True):
                found[i] = array("I", e.ids).tobytes()
            self.table.add({distinct[i]: found[i] for i in fresh}, lambda: set(distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        ends = 4 * ends[lists.offsets.to_numpy()]
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    @staticmethod
    def _strings(words: pa.Array) -> list[bytes]:
        """The words of an Arrow array, by their places in its buffer, which takes a tenth of the time of ``to_pylist``."""
        if not len(words):
            return []
        _, places, data = words.buffers()
        places = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
        data = data.to_pybytes() if data is not None else b""
        return [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    @staticmethod
    def _plain(texts: pa.Array) -> pa.Array:
        """Lower case, a blank before a mark that follows a letter: fewer distinct words, the same ids.

        The tokenizer lower-cases and splits there itself. Not so for texts with special tokens or with combining
        marks (U+0300 to U+037F), which it looks at or joins before it lower-cases: they stay as they are.
        """
        kept = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, COMBINING))
        return pc.if_else(kept, texts, pc.replace_substring_regex(pc.ascii_lower(texts), MARK, r"\1 \2"))
