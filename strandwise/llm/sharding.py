"""Minimax contiguous partition of documents into shards, by DataFrame operations only.

Documents with equal texts form one atomic group.  Groups are ordered by a hash of their text; the
smallest feasible shard capacity is found by binary search over the ordered group sizes, each trial
checked greedily, and the order is cut there.

The search runs on the driver over a bounded outline of the order: first and last group begin in each of at
most ``RUNS`` stretches of bytes.  A trial that counts only these begins as cuts bounds the capacity from above;
one that may cut anywhere between a stretch's first and last begin bounds it from below.  While the bounds
differ, the stretches in which a cut can still fall are outlined more finely, again ``RUNS`` of them, so the result is
exact for single groups and the driver's memory doesn't depend on the input.

No group is gathered in a task: positions come from range partitions of single documents, numbered rows of one
text and id included, and a document's shard follows from the byte position at which its group begins.

Null texts count as empty: both have 8 bytes and form one group.  Repeated ids and null ids are placed like
any other rows; a text of any length is one row of its size.  An empty table gives an empty result.  Columns
other than id and text are never read, so their names can't clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked

RUNS = 1 << 16


class Outline:
    """Stretches (first begin, last begin, k) of 2^k bytes each that hold begins; 0 is a begin."""

    def __init__(self, stretches: list[tuple[int, int, int]], total: int):
        self.total = total
        self.stretches = sorted(stretches)
        self.firsts = [s[0] for s in self.stretches]

    def reach(self, x: int, hopeful: bool) -> int:
        """The last begin that is at most ``x``: surely one, or possibly one."""
        first, last, _ = self.stretches[bisect_right(self.firsts, x) - 1]
        return last if last <= x else x if hopeful else first

    def fill(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int], bool]:
        """Cuts of a greedy fill, and whether ``shards`` shards do."""
        cuts: list[int] = []
        at = 0
        while self.total - at > capacity:
            to = self.reach(at + capacity, hopeful)
            if to <= at or len(cuts) + 1 >= shards:
                return cuts, False
            cuts.append(at := to)
        return cuts, True

    def least(self, shards: int, hopeful: bool) -> int:
        """The smallest capacity that a greedy fill can meet."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, hopeful)[1]:
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, shards: int) -> list[tuple[int, int, int]]:
        """Stretches in which a cut may still fall at more than one place; none once the capacity is certain."""
        low, high = self.least(shards, True), self.least(shards, False)
        if low == high:
            return []
        # Cut k + 1 is sought within the capacity after cut k, and both lie between these fills.
        sure, hoped = [0, *self.fill(low, shards, False)[0]], [0, *self.fill(high, shards, True)[0]]
        found = set()
        for k in range(shards):
            a = sure[min(k, len(sure) - 1)] + low
            b = hoped[k] + high if k < len(hoped) else self.total
            found.update(s for s in self.stretches[max(0, bisect_right(self.firsts, a) - 1) : bisect_right(self.firsts, b)] if s[0] < s[1])
        return sorted(found)


def minimax_cuts(outline: Outline, shards: int, finer) -> list[int]:
    """Cuts for the smallest capacity; ``finer`` gives the stretches within those that are still open."""
    while todo := outline.open(shards):
        outline = Outline([*(set(outline.stretches) - set(todo)), *finer(todo)], outline.total)
    return outline.fill(outline.least(shards, False), shards, False)[0]


def _outlined(groups: DataFrame, k: int) -> list[tuple[int, int, int]]:
    """First and last begins within each 2^k bytes; the caller bounds how many there are."""
    stretch = F.shiftright(F.col("begin"), k)
    return [(r["a"], r["b"], k) for r in groups.groupBy(stretch.alias("s")).agg(F.min("begin").alias("a"), F.max("begin").alias("b")).toLocalIterator()]


def _finer(groups: DataFrame, todo: list[tuple[int, int, int]], runs: int) -> list[tuple[int, int, int]]:
    found = []
    for k in {s[2] for s in todo}:
        some = [s[0] >> k for s in todo if s[2] == k]  # the few stretches round each cut
        down = max(1, (runs // len(some)).bit_length() - 1)
        found += _outlined(groups.filter(F.shiftright(F.col("begin"), k).isin(some)), max(0, k - down))
    return found


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots count from 0 in each shard without gaps."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),  # with size and crc32: 96 bits and the length
        F.monotonically_increasing_id().alias("_row"),  # parts rows of one text and id, so that ranges can divide them
    )
    key = ["_hash", "text_crc32", "size"]
    placed = cut(ranked(rows, [*key, "doc_id", "_row"], {"_before": "size"}, "shards"), "placed")
    total, n = placed.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.col("row_index").alias("slot"))
    groups = cut(placed.groupBy(*key).agg(F.min("_before").alias("begin")).select("begin"), "groups")
    outline = Outline(_outlined(groups, max(0, (total // runs).bit_length())), total)
    cuts = minimax_cuts(outline, shards, lambda todo: _finer(groups, todo, runs))
    # A cut is the begin of a group, so a document's own position places it with its group.
    shard = sum([(F.col("_before") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    firsts = placed.filter(F.col("_before").isin([0, *cuts])).select(F.col("_before").alias("_cut"), F.col("row_index").alias("_first"))
    offset = F.lit(0).cast("long")
    found = {r["_cut"]: r["_first"] for r in firsts.collect()}  # one row for each shard
    for c in cuts:
        offset = F.when(F.col("_before") >= F.lit(c), F.lit(found[c]).cast("long")).otherwise(offset)
    return placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("row_index") - offset).alias("slot"))
