"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has one bit for each of 64 positions: 1 if set in over half of the hashes of the text's
word shingles.  Two fingerprints are linked at ``threshold`` or fewer differing bits.

Pigeonring: lay the fingerprint's ``threshold + 1`` segments in a ring.  If the total difference is at
most the threshold, some segment starts a chain whose cumulative difference over its first l segments
is at most floor(l * threshold / segments) for every l.  The first step of a chain must be equal, so
fingerprints are dealt by (start, segment value); within such a bucket the longer chains prune the pairs
before the full Hamming check.  A bucket of more than ``block`` fingerprints is dealt as pairs of blocks,
so that no task holds an unbounded bucket, and each task returns a spanning forest of the links it finds
and not the links themselves.

Null and empty texts have fingerprint zero and are linked like any other.  Repeated texts share one
fingerprint, which is compared once.  A row with a null id keeps its fingerprint and has as component
the smallest id reachable, null where none is.  Texts of any length are read whole.  An empty table gives an
empty result.  Columns other than id and text are carried as they are or not read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_rows, cut, slices, split_join
from .components import connected_components

SEED = 42
#: Pairs looked at in one vectorised step.
STEP = 1 << 20


def text_fingerprint(text: bytes | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, text_col: str = "text", shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """(_row, fp): rows beside the fingerprints of their texts; one map pass."""

    def make():
        return lambda texts: [pa.array(np.array([text_fingerprint(None if t is None else t.encode("utf-8", "surrogatepass"), shingle) for t in texts], np.uint64).view(np.int64))]

    return beside_rows(docs, text_col, "fp long", make, carry)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one map pass, texts are never shuffled."""
    return fingerprinted(docs, text_col, shingle, [id_col]).select(F.col("_row")[id_col].alias("doc_id"), "fp")


def ring_links(x: np.ndarray, y: np.ndarray, start: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of fingerprints, equal on the segment ``start``, are linked: chains first, all bits last."""
    m = threshold + 1
    width = 64 // m
    at = np.arange(len(x))
    for length in range(2, m):
        if not len(at):
            return at
        diff = x[at] ^ y[at]
        low = (start[at] * width).astype(np.uint64)
        span = length * width
        # The chain's bits, turned down to the low end of the word.
        turned = (diff >> low) | np.where(low > 0, diff << ((np.uint64(64) - low) & np.uint64(63)), np.uint64(0))
        at = at[np.bitwise_count(turned & np.uint64((1 << span) - 1)) <= length * threshold // m]
    return at[np.bitwise_count(x[at] ^ y[at]) <= threshold]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links as (node, smallest node of its component) pairs."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def bucket_links(start: np.ndarray, bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, rep: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``bucket`` (sorted).  side 0: compare with all; 1, 2: only with the other side."""
    n = len(fp)
    if n < 2:
        return rep[:0], rep[:0]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    todo = end - np.arange(n) - 1  # later rows of the same bucket
    total = np.cumsum(todo)
    out_a, out_b = [], []
    row = 0
    while row < n:
        done = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + STEP, "right")))
        counts = todo[row:stop]
        i = np.repeat(np.arange(row, stop), counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        across = (side[i] == 0) | (side[i] != side[j])
        i, j = i[across], j[across]
        at = ring_links(fp[i], fp[j], start[i], threshold)
        if len(at):
            a, b = forest(rep[i[at]], rep[j[at]])
            out_a.append(a)
            out_b.append(b)
        row = stop
    if not out_a:
        return rep[:0], rep[:0]
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def fingerprint_links(distinct: DataFrame, threshold: int = 3, block: int = 4096) -> DataFrame:
    """(a, b): a linear number of links that connect all fingerprints within ``threshold`` bits.

    ``distinct`` has one row (fp, rep) for each distinct fingerprint.  Only buckets of more than one block are
    looked up; there are at most (threshold + 1) * 2^(64 / (threshold + 1)) buckets whatever the input.
    """
    m = threshold + 1
    if 64 % m:
        raise ValueError("threshold + 1 must divide 64")
    width = 64 // m
    mask = (1 << width) - 1
    dealt = distinct.select("fp", "rep", F.posexplode(F.array(*[F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask)) for k in range(m)])).alias("start", "segment"))
    sizes = dealt.groupBy("start", "segment").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).filter("blocks > 1")
    sized = dealt.join(F.broadcast(sizes) if width <= 16 else sizes, ["start", "segment"], "left").fillna({"blocks": 1})
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    sized = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sized = sized.select(
        "start", "fp", "rep",
        F.xxhash64("start", "segment", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        # Two buckets whose hashes agree would be compared needlessly, never wrongly: links are checked on all bits.
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(parts):
            a, b = bucket_links(parts[0], parts[3], parts[4], parts[1].view(np.uint64), parts[2], threshold)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if not len(held[0]) or len(held[0]) < 1 << 15:
                continue
            cutoff = int(np.searchsorted(held[3], held[3][-1]))  # the last bucket may go on
            if cutoff:
                yield links([x[:cutoff] for x in held])
                held = [x[cutoff:] for x in held]
        if held:
            yield links(held)

    return sized.repartition("bucket").sortWithinPartitions("bucket").select("start", "fp", "rep", "bucket", "side").mapInArrow(run, "a long, b long")


def _placed(prints: DataFrame, threshold: int, block: int) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with root, which numbers the component, and component_id, its smallest id."""
    grouped = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    distinct = cut(grouped.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    comps = connected_components(fingerprint_links(distinct, threshold, block))
    roots = cut(distinct.join(comps, F.col("rep") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("component", "rep").alias("root")), "roots")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_members"))
    n, all_rows = roots.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    groups = split_join(roots.select("fp", "rows", "root"), named, "root", "_members", n)
    return split_join(prints, groups, "fp", "rows", all_rows)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 3, block: int = 4096) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row."""
    placed = _placed(cut(fingerprints(docs, id_col, text_col, shingle), "prints"), threshold, block)
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 3, block: int = 4096) -> DataFrame:
    """Exactly one row of ``docs`` for each component: that of the smallest id, null ids last.

    Of rows with this id the one whose text has the least hash stays; of rows equal in both, any one.  Rows are
    written once with a number and their fingerprint; the numbers of the rows that go (few, as a rule) are
    then taken out, by a broadcast where Spark finds them small enough.
    """
    numbered = fingerprinted(docs, text_col, shingle).withColumn("_number", F.monotonically_increasing_id())
    held = cut(numbered.withColumn("_text", F.xxhash64(F.col("_row")[text_col])), "numbered")
    prints = held.select(F.col("_row")[id_col].alias("doc_id"), "fp", "_text", "_number")
    placed = cut(_placed(prints, threshold, block).select("root", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text", "_number").alias("rank")), "placed")
    first = placed.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank._number").alias("_number"))
    gone = placed.select(F.col("rank._number").alias("_number")).join(first, "_number", "left_anti")
    return held.join(gone, "_number", "left_anti").select("_row.*")
