"""Packing token pieces into sequences: as they come, then a swap-based local search between underfull bins."""

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.buckets import map_units
from millrace.llm.shared import map_texts, written
from millrace.llm.word_ids import WordIds


class Packing:
    """Bins of at most ``capacity`` holding item numbers of the given sizes."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.least = -(-sum(sizes) // capacity)  # no packing has fewer bins

    def in_order(self) -> "Packing":
        """Items as they come, each into the last bin or, if it does not fit, into a new one."""
        for item, size in enumerate(self.sizes):
            if not self.bins or self.fill[-1] + size > self.capacity:
                self.bins.append([])
                self.fill.append(0)
            self.bins[-1].append(item)
            self.fill[-1] += size
        return self

    def best_fit(self) -> "Packing":
        """Items from the largest to the smallest, each into the bin that it leaves the least room in."""
        rooms: list[tuple[int, int]] = []
        for item in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            at = bisect_left(rooms, (self.sizes[item], -1))
            room, here = rooms.pop(at) if at < len(rooms) else (self.capacity, len(self.bins))
            if here == len(self.bins):
                self.bins.append([])
                self.fill.append(0)
            self.bins[here].append(item)
            self.fill[here] += self.sizes[item]
            insort(rooms, (room - self.sizes[item], here))
        return self

    def local_search(self) -> "Packing":
        """Exchange items between underfull bins as long as the sum of squared fills grows, until bins empty.

        In turn, emptiest first, every underfull bin gives to fuller ones: an item into free room, an item for a smaller
        one, two items for a smaller one, or an item for two that are smaller. Of the targets the one is taken that is
        left with the least room. Each exchange adds to the sum of squares. The search goes over all bins again
        until a round empties none, or no packing could have fewer.
        """
        self.used, before = sum(map(bool, self.bins)), None
        index = _Targets(self)
        while self.least < self.used != before:
            before = self.used
            for donor in sorted(range(len(self.bins)), key=lambda b: (self.fill[b], b)):
                if 0 < self.fill[donor] < self.capacity:
                    index.remove(donor)
                    while self.bins[donor] and (found := index.best(donor)):
                        self._exchange(donor, *found, index)
                    if self.bins[donor]:
                        index.add(donor)
                    else:
                        self.used -= 1
                if self.used == self.least:
                    break
        keep = [i for i, b in enumerate(self.bins) if b]
        self.bins, self.fill = [self.bins[i] for i in keep], [self.fill[i] for i in keep]
        return self

    def _exchange(self, donor: int, target: int, out: tuple, back: tuple, index: "_Targets") -> None:
        index.remove(target)
        gain = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
        self.bins[donor] = [i for i in self.bins[donor] if i not in out] + [*back]
        self.bins[target] = [i for i in self.bins[target] if i not in back] + [*out]
        self.fill[donor] -= gain
        self.fill[target] += gain
        index.add(target)


def fewest_bins(sizes: list[int], capacity: int) -> Packing:
    """The search from the items as they come and, unless that finds the least that any packing has, from their best fit.

    The search ends where no exchange helps, which on wide sizes can be above best fit; of the two ends that with fewer bins
    is taken, the first of equal ones.
    """
    found = Packing(sizes, capacity).in_order().local_search()
    if len(found.bins) > found.least:
        other = Packing(sizes, capacity).best_fit().local_search()
        found = other if len(other.bins) < len(found.bins) else found
    return found


class _Targets:
    """Underfull bins by what they can take in: the room, and the room with one or two of their items gone.

    A bit mask of the amounts that occur finds the least one that is enough. Bins are listed apart by the bits of their
    room, since one of little room gains only where less is left. Of items of one size in a bin one is listed.
    """

    def __init__(self, packing: Packing):
        self.packing, bits = packing, packing.capacity.bit_length() + 1
        # By number of items to give back and bits of the room: amount -> {(bin, items): None}, and the mask of amounts.
        self.places = [[{} for _ in range(bits)] for _ in range(3)]
        self.masks = [[0] * bits for _ in range(3)]
        self.listed: dict[int, list] = {}
        for b in range(len(packing.bins)):
            self.add(b)

    def add(self, b: int) -> None:
        room, sizes = self.packing.capacity - self.packing.fill[b], self.packing.sizes
        if not room or not self.packing.bins[b]:
            return
        own = [*{sizes[i]: i for i in self.packing.bins[b]}.items()]
        entries = [(0, room, (b, ()))]
        entries += [(1, room + s, (b, (i,))) for s, i in own]
        entries += [(2, room + s + t, (b, (i, j))) for n, (s, i) in enumerate(own) for t, j in own[:n]]
        bits = room.bit_length()
        for level, amount, entry in entries:
            at = self.places[level][bits].get(amount)
            if at is None:
                at = self.places[level][bits][amount] = {}
                self.masks[level][bits] |= 1 << amount
            at[entry] = None
        self.listed[b] = bits, entries

    def remove(self, b: int) -> None:
        bits, entries = self.listed.pop(b, (0, ()))
        for level, amount, entry in entries:
            at = self.places[level][bits][amount]
            del at[entry]
            if not at:
                del self.places[level][bits][amount]
                self.masks[level][bits] ^= 1 << amount

    def best(self, donor: int) -> tuple | None:
        """``(target, items out, items back)`` of the exchange that leaves its target the least room; None without one."""
        sizes, own = self.packing.sizes, {}
        for i in self.packing.bins[donor]:
            own.setdefault(sizes[i], []).append(i)
        single = sorted(((s, (ids[0],)) for s, ids in own.items()), reverse=True)
        fill, best = self.packing.fill[donor], None
        for level in (0, 1, 2):
            for size, out in single:
                best = self._better(best, level, size, out, fill)
                if best and best[0] == 0:
                    return best[1:]
            if best:  # a kind of exchange that moves fewer items comes first
                return best[1:]
        pairs = {s + t: (a[0], b[0]) for n, (s, a) in enumerate(single) for t, b in single[:n]}
        pairs |= {2 * s: tuple(ids[:2]) for s, ids in own.items() if len(ids) > 1}
        for size, out in sorted(pairs.items(), reverse=True):
            best = self._better(best, 1, size, out, fill)
            if best and best[0] == 0:
                break
        return best[1:] if best else None

    def _better(self, best: tuple | None, level: int, size: int, out: tuple, fill: int) -> tuple | None:
        """The better of ``best`` and the tightest exchange of ``out`` that makes the sum of squares grow."""
        packing = self.packing
        # What is left of the target's room must be less than the donor's room, or the sum of squares would not grow.
        most = best[0] if best else packing.capacity - fill
        for bits, mask in enumerate(self.masks[level]):
            mask = mask >> size & (1 << min(most, 1 << bits)) - 1
            while mask:
                low = mask & -mask
                left = low.bit_length() - 1
                found = next((x for x in self.places[level][bits][size + left] if packing.capacity - packing.fill[x[0]] > left), None)
                if found:  # else nothing is gained there
                    best, most = (left, found[0], out, found[1]), left
                    break
                mask ^= low
            if not most:
                break
        return best


def cut_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, row_id, piece, start, length, ids)``: each text's ids and ``end_id``, cut only if over ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers, ``row_id`` tells input rows apart whatever their ids. Null
    texts count as empty and give one piece of the end id. The result is a written table, so row ids are stable.
    """
    step = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(
        F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row_id")).alias("key"),
        F.col(f"`{text_col}`").alias("text"),
    )

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        encoder = WordIds.load(tokenizer_path)
        for keys, texts in batches:
            at, piece, pieces = [], [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in texts])):
                ids += end
                for n, start in enumerate(range(0, len(ids), step)):
                    at.append(i)
                    piece.append(n)
                    pieces.append(ids[start : start + step])
            columns = [
                keys.take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array([n * capacity for n in piece], pa.int64()),
                pa.array([len(p) // 4 for p in pieces], pa.int64()),
                pa.array(pieces, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids"])

    out = map_texts(rows, run, "piece int, start long, length long, ids binary", "key", uses="word_ids")
    return written(out.select("key.*", "piece", "start", "length", "ids"), "pieces")


def assign_sequences(pieces: DataFrame, capacity: int = 4096, pool: int = 16_384) -> DataFrame:
    """``(row_id, piece, sequence_id, offset)`` for every piece, in as few sequences as the method finds.

    A piece of full length is a sequence of its own. The others are dealt by a hash into pools of about ``pool``
    pieces, each filled in order of the input and packed by local search; only sizes travel, not ids. A pool has at most a few sequences
    more than all pieces together would need, so the loss is a fixed small share at any scale.
    """
    sizes = pieces.select("row_id", "piece", "length")
    full = sizes.where(F.col("length") == capacity)
    full = full.select("row_id", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = sizes.where(F.col("length") < capacity)
    pools = max(1, -(-rest.count() // pool))
    rest = rest.withColumn("pool", F.pmod(F.xxhash64("row_id", "piece"), F.lit(pools)))

    def pack(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by([("row_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        packing = fewest_bins(lengths, capacity)
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for at, items in enumerate(packing.bins):
            place = 0
            for item in sorted(items):
                number[item], offset[item] = at, place
                place += lengths[item]
        number += table.column("pool")[0].as_py() << 32
        columns = [table.column("row_id").combine_chunks(), table.column("piece").combine_chunks(), pa.array(number), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, ["row_id", "piece", "sequence_id", "offset"])

    schema = "row_id long, piece int, sequence_id long, offset long"
    packed = map_units(rest.select("pool", "row_id", "piece", "length"), ["pool"], pack, schema)
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row for each piece of every text.

    Repeated rows and null ids are packed like any others; an empty table gives an empty result. Ids stay in the
    written piece table; only their checksums meet the places.
    """
    pieces = cut_pieces(docs, tokenizer_path, capacity, end_id)
    places = assign_sequences(pieces, capacity)
    digests = pieces.select("doc_id", "row_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    out = digests.join(places, ["row_id", "piece"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the ids of each sequence, its pieces in order of offset. A sequence is one row's size."""
    rows = pieces.join(places, ["row_id", "piece"])
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("x"))
    return parts.select("sequence_id", F.unhex(F.array_join(F.col("x.h"), "")).alias("ids"))
