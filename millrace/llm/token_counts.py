"""Token counts by byte-pair merging on a heap and a linked list."""

import functools
import heapq
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import PLACE, BoundedCache, cache_of, map_texts

# The white space of the Unicode White_Space property, and the byte-level split pattern.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
SPLIT = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Merges:
    """A tokenizer's merges by whole numbers: symbols and merged symbols have ids, pairs of ids the rank of their merge."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ids: dict[str, int] = {}
        for left, right in ranks:
            for symbol in (left, right, left + right):
                self.ids.setdefault(symbol, len(self.ids))
        self.rank = {self.ids[left] << 32 | self.ids[right]: rank for (left, right), rank in ranks.items()}
        self.made = {rank: self.ids[left + right] for (left, right), rank in ranks.items()}

    def id_of(self, symbol: str) -> int:
        return self.ids.setdefault(symbol, len(self.ids))


def merged_length(symbols: list[int], merges: Merges) -> int:
    """How many symbols remain when the adjacent pair of lowest rank (leftmost on ties) is merged until none is left.

    A heap holds candidate pairs, as one number of rank and place, a doubly linked list the symbols that remain; an entry is
    stale unless it has the present rank of the pair at its place. O(n log n) for any word length.
    """
    n, ranks, made = len(symbols), merges.rank, merges.made
    present = [ranks.get(left << 32 | right, -1) for left, right in zip(symbols, symbols[1:])]
    present = [rank << 32 | i if rank >= 0 else -1 for i, rank in enumerate(present)]
    heap = [entry for entry in present if entry >= 0]
    heapq.heapify(heap)
    symbols, present = [*symbols], [*present, -1]
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    left = n
    while heap:
        entry = heapq.heappop(heap)
        i = entry & 0xFFFFFFFF
        if present[i] != entry:
            continue
        j = after[i]
        symbol = symbols[i] = made[entry >> 32]
        left -= 1
        present[i] = present[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(symbol << 32 | symbols[k])
            if rank is not None:
                present[i] = rank << 32 | i
                heapq.heappush(heap, present[i])
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbols[h] << 32 | symbol)
            if rank is None:
                present[h] = -1
            else:
                present[h] = rank << 32 | h
                heapq.heappush(heap, present[h])
    return left


class AgingCache(BoundedCache):
    """A bounded cache of two halves: when the newer one is full it becomes the older one, from which used entries return."""

    def __init__(self, make, megabytes: float):
        super().__init__(make, megabytes / 2)
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        cost = PLACE + sys.getsizeof(key) + sys.getsizeof(value)
        if self.held + cost > self.limit:
            self.older = dict(self)
            BoundedCache.clear(self)
        self.held += cost
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.older = {}


class MergeCounter:
    """Counts a text's tokens from the merge list of a byte-level tokenizer file, without making any ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges({tuple(pair): rank for rank, pair in enumerate(spec["model"]["merges"])})
        self.symbol = [self.merges.id_of(s) for s in byte_symbols()]
        self.pieces = regex.compile(SPLIT)
        # A space before a visible character always starts a piece, so the parts between such places are independent.
        self.parts = regex.compile(rf"(?= [^{WHITE}])")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.odd = regex.compile(r" (?:\s|$)")
        # Words that differ only in the marks behind them share their letters' piece.
        self.of_piece = cache_of("token_counts", f"pieces {path}", AgingCache(self._piece, 96))
        self.of_part = cache_of("token_counts", f"parts {path}", BoundedCache(self._part, 16))
        spaced = AgingCache(lambda part: self._part(" " + part), 128)
        self.after_space = cache_of("token_counts", f"words {path}", spaced)

    def _piece(self, piece: str) -> int:
        return merged_length([*map(self.symbol.__getitem__, piece.encode("utf-8"))], self.merges)

    def _part(self, part: str) -> int:
        return sum(map(self.of_piece.__getitem__, self.pieces.findall(part)))

    def count(self, text: str) -> int:
        total, stretches = 0, [text]
        if self.added is not None and self.added.search(text):
            stretches = self.added.split(text)
            total = len(stretches) - 1
        for stretch in stretches:
            if self.odd.search(stretch):
                total += sum(map(self.of_part.__getitem__, self.parts.split(stretch)))
            else:
                first, *rest = stretch.split(" ")
                total += self.of_part[first] + sum(map(self.after_space.__getitem__, rest))
        return total


@functools.cache
def counter_of(path: str) -> MergeCounter:
    """The one counter of a worker process for a tokenizer file."""
    return MergeCounter(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every text, with the counts that the tokenizer would give.

    ``tokenizer_path`` is a byte-level BPE file that every worker can read. Each word is merged by
    :func:`merged_length` once per worker (bounded cache) and texts add up their words' counts, so memory does not
    depend on a text's length. Null and empty texts have 0 bytes and 0 tokens; special tokens found in a text count
    as one token each; repeated rows and null ids give one result row per input row. One narrow map, no shuffle.
    """

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for ids, texts in batches:
            texts = [t or "" for t in texts]
            n_tokens = [counter.count(t) for t in texts]
            n_bytes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )

    counted = map_texts(docs, run, "n_bytes long, n_tokens long", id_col, text_col, uses="token_counts")
    return counted.select(
        F.col("key").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
