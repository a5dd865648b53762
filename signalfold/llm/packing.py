"""Best-fit packing of token pieces into sequences, improved by a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.llm.bpe import encoder, text_blocks
from signalfold.llm.worker import giving_back

# Pieces that are packed together; each group wastes less than one sequence or so.
GROUP = 50_000


class Bins:
    """Bins of one capacity; finds the fullest bin that still takes a size."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self._by_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self._some = 0  # bit f is set where a bin has f free places

    def _set_free(self, bin_: int, free: int) -> None:
        old = self.free[bin_]
        self._by_free[old].discard(bin_)
        if not self._by_free[old]:
            self._some &= ~(1 << old)
        self.free[bin_] = free
        self._by_free[free].add(bin_)
        self._some |= 1 << free

    def best(self, size: int, but: int = -1) -> int:
        """The bin with the least free room of at least `size`, or -1."""
        rest = self._some >> size << size
        while rest:
            low = rest & -rest
            for bin_ in self._by_free[low.bit_length() - 1]:
                if bin_ != but:
                    return bin_
            rest ^= low
        return -1

    def open(self) -> int:
        self.items.append([])
        self.free.append(self.capacity)
        self._by_free[self.capacity].add(len(self.free) - 1)
        self._some |= 1 << self.capacity
        return len(self.free) - 1

    def put(self, bin_: int, item: int, size: int) -> None:
        self.items[bin_].append(item)
        self._set_free(bin_, self.free[bin_] - size)

    def take(self, bin_: int, item: int, size: int) -> None:
        self.items[bin_].remove(item)
        self._set_free(bin_, self.free[bin_] + size)

    def drop(self, bin_: int) -> None:
        """An empty bin takes nothing any more."""
        self._by_free[self.free[bin_]].discard(bin_)
        if not self._by_free[self.free[bin_]]:
            self._some &= ~(1 << self.free[bin_])


def pack(sizes: list[int], capacity: int, rounds: int = 3, partners: int = 64) -> tuple[list[int], list[int]]:
    """Bin and offset of every item.

    Best-fit decreasing first.  Then, while more bins are open than the total needs, the emptiest
    bins give their items away: each is moved to another bin with room, exchanged for a smaller
    item of a fuller bin, or two of them for one item, always so that the fuller bin becomes
    fuller and the sum of squared fills rises.  A bin that becomes empty is closed.  `partners`
    fuller bins are tried for an item, `rounds` passes are made; both only bound the search, all
    items stay packed.
    """
    bins = Bins(capacity)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bin_ = bins.best(sizes[item])
        bins.put(bin_ if bin_ >= 0 else bins.open(), item, sizes[item])
    least = -(-sum(sizes) // capacity)
    open_ = sum(1 for x in bins.items if x)
    for _ in range(rounds):
        changed = False
        donors = sorted((b for b, x in enumerate(bins.items) if x and bins.free[b]), key=lambda b: -bins.free[b])
        under = donors[::-1]  # the fullest of the underfull bins come first
        # No more than `open_ - least` bins can be closed, so only some of the emptiest give away.
        for donor in donors[: 4 * (open_ - least) + 8]:
            if open_ <= least:
                break
            for item in sorted(bins.items[donor], key=lambda i: -sizes[i]):
                changed |= _give(bins, sizes, donor, item, under, partners)
            if not bins.items[donor]:
                bins.drop(donor)
                open_ -= 1
        if not changed or open_ <= least:
            break
    place, offset, number = [0] * len(sizes), [0] * len(sizes), 0
    for content in bins.items:
        at = 0
        for item in content:
            place[item], offset[item] = number, at
            at += sizes[item]
        number += bool(content)
    return place, offset


def _give(bins: Bins, sizes: list[int], donor: int, item: int, under: list[int], partners: int) -> bool:
    """Move one item of the donor, or exchange it (or it and a second one) for a smaller one elsewhere."""
    if item not in bins.items[donor]:
        return False  # went as the second of two
    size, fill = sizes[item], bins.capacity - bins.free[donor]
    target = bins.best(size, but=donor)
    if target >= 0 and bins.capacity - bins.free[target] + size > fill:
        bins.take(donor, item, size)
        bins.put(target, item, size)
        return True
    seconds = [i for i in bins.items[donor] if i != item][:8]
    tried = 0
    for target in under:
        room = bins.free[target]
        if target == donor or not room or not bins.items[target] or bins.capacity - room < fill:
            continue
        tried += 1
        if tried > partners:
            break
        gain, given, taken = 0, (), -1
        for other in bins.items[target]:
            for mine in ((item,), *((item, s) for s in seconds)):
                more = sum(sizes[i] for i in mine) - sizes[other]
                if gain < more <= room:
                    gain, given, taken = more, mine, other
        if gain:
            for i in given:
                bins.take(donor, i, sizes[i])
            bins.take(target, taken, sizes[taken])
            for i in given:
                bins.put(target, i, sizes[i])
            bins.put(donor, taken, sizes[taken])
            return True
    return False


def pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """Every document as pieces of at most `capacity` tokens; the first one takes the remainder.

    Columns doc_id, piece, start, length, ids_crc32 and `_turn` (spreads the rows evenly).
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, turn = encoder(tokenizer), TaskContext.get().partitionId()
        for batch in batches:
            for some in text_blocks(batch):
                rows = []
                for doc_id, raw in zip(some.column(0).to_pylist(), bpe.encode(some.column(1).to_pylist()), strict=True):
                    ids = memoryview(raw + end)
                    total = len(ids) // 4
                    start, length = 0, total % capacity or capacity
                    for piece in range(-(-total // capacity)):
                        rows.append((doc_id, piece, start, length, zlib.crc32(ids[start * 4 : (start + length) * 4]), turn))
                        start, length, turn = start + length, capacity, turn + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES
                )

    TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "_turn"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, _turn long")


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, group: int = GROUP,
) -> DataFrame:
    """All documents packed into sequences of at most `capacity` tokens, one row per piece.

    Pieces are dealt out evenly, whatever their document, into groups of about `group`, each
    packed by `pack` in one task; only sizes travel, no tokens.  A null or empty text is one
    piece with the end id.  Rows that share an id are packed as documents of their own, a null
    id stays null, an empty table gives no rows and other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        place, offset = pack(rows["length"].tolist(), capacity)
        first = int(rows["_group"].iloc[0]) << 40
        return rows.assign(sequence_id=first + np.array(place, np.int64), offset=np.array(offset, np.int64)).drop(
            columns=["_group"]
        )

    dealt = pieces(docs, tokenizer, capacity=capacity, id_col=id_col, text_col=text_col, end_id=end_id)
    dealt = dealt.withColumn("_group", F.pmod("_turn", F.lit(groups))).drop("_turn")
    return dealt.groupBy("_group").applyInPandas(
        fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
