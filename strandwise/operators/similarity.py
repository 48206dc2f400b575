"""Similarities, distances and neighbours."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import checkpointed


def slot_similarity(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures."""
    return F.size(common_objects(a, b)) / F.size(a)


def common_objects(a: Column, b: Column) -> Column:
    """The values of the slots in which two signatures agree."""
    return F.filter(F.zip_with(a, b, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())


def hamming_distance(a: Column, b: Column) -> Column:
    return 1 - slot_similarity(a, b)


def block_distance(seq_a: Column, seq_b: Column, a: Column, b: Column) -> Column:
    """1 for blocks of one sequence, else the share of slots that differ."""
    return F.when(seq_a == seq_b, F.lit(1.0)).otherwise(hamming_distance(a, b))


def set_jaccard(weights: DataFrame, query: DataFrame) -> DataFrame:
    """(seq_id, n_common, jaccard) of every sequence's k-mer set with one query set (kmer, weight)."""
    size = query.agg(F.count("*").alias("n_query"))
    hit = weights.join(query.select("kmer", F.lit(1).alias("hit")), "kmer", "left")
    per = hit.groupBy("seq_id").agg(F.count("*").alias("n"), F.count("hit").alias("n_common"))
    return per.crossJoin(F.broadcast(size)).select("seq_id", "n_common", (F.col("n_common") / (F.col("n") + F.col("n_query") - F.col("n_common"))).alias("jaccard"))


def probability_jaccard(weights: DataFrame, query: DataFrame) -> DataFrame:
    """(seq_id, jp): sum over common d of 1 / sum over d' of max(a(d') / a(d), b(d') / b(d)).

    For one query the inner sum splits at the ratio a / b: sorted by it, running sums of a and b over the
    query's own k-mers give it in one window over at most the query's k-mers for each sequence.
    """
    joined = weights.join(query.select("kmer", F.col("weight").alias("b")), "kmer", "left").withColumnRenamed("weight", "a")
    totals = joined.groupBy("seq_id").agg(F.sum("a").alias("sum_a"), F.sum("b").alias("b_common"))
    common = joined.filter("b IS NOT NULL").withColumn("r", F.col("a") / F.col("b"))
    up = W.partitionBy("seq_id").orderBy("r").rangeBetween(W.unboundedPreceding, 0)
    run = common.select("seq_id", "a", "b", F.sum("a").over(up).alias("a_upto"), F.sum("b").over(up).alias("b_upto"))
    whole = query.agg(F.sum("weight").alias("sum_b"))
    x = run.join(totals, "seq_id").crossJoin(F.broadcast(whole))
    # d' with a larger ratio, or missing in the query, count a(d') / a(d); the rest count b(d') / b(d).
    inner = (F.col("sum_a") - F.col("a_upto")) / F.col("a") + (F.col("b_upto") + F.col("sum_b") - F.col("b_common")) / F.col("b")
    scored = x.groupBy("seq_id").agg(F.sum(1 / inner).alias("jp"))
    return totals.select("seq_id").join(scored, "seq_id", "left").select("seq_id", F.coalesce("jp", F.lit(0.0)).alias("jp"))


def sketch_similarity(sigs: DataFrame, query_sig: DataFrame) -> DataFrame:
    """(seq_id, sim): share of equal slots with one query signature, sent to all tasks; several are an error."""
    only = F.when(F.count("*") <= 1, F.first("sig")).otherwise(F.raise_error(F.lit("more than one query signature")))
    one = query_sig.agg(only.alias("_q")).filter("_q IS NOT NULL")
    return sigs.crossJoin(F.broadcast(one)).select("seq_id", slot_similarity(F.col("sig"), F.col("_q")).alias("sim"))


def minhash_distance(sketches: DataFrame, query: DataFrame, size: int) -> DataFrame:
    """(seq_id, containment, jaccard, common, total) of bottom-k sketches with one query sketch (hash).

    The sketch of the union is the ``size`` smallest hashes of both; ``total`` counts them, ``common``
    those in both, and containment is common over the sequence's own hashes among them.
    """
    few = query.select("hash").orderBy("hash").limit(size)  # larger ones can't be among the union's ``size`` smallest
    its = few.agg(F.collect_list("hash").alias("its"))
    rows = sketches.groupBy("seq_id").agg(F.collect_list("hash").alias("own")).crossJoin(F.broadcast(its))
    top = F.slice(F.array_sort(F.array_union("own", "its")), 1, size)
    rows = rows.select("seq_id", "own", "its", top.alias("top"))
    mine = F.array_intersect("top", "own")
    out = rows.select("seq_id", F.size(F.array_intersect(mine, F.col("its"))).cast("long").alias("common"), F.size("top").cast("long").alias("total"), F.size(mine).cast("long").alias("n_mine"))
    return out.select("seq_id", F.when(F.col("n_mine") > 0, F.col("common") / F.col("n_mine")).otherwise(F.lit(0.0)).alias("containment"), (F.col("common") / F.col("total")).alias("jaccard"), "common", "total")


def agreements(rows: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(a_key, b_key, slot, value) for each slot in which two signatures (keys, slot, value) agree, with a before b.

    The inner join on (slot, value); pairs without an equal slot have no row.
    """
    one = rows.select(*[F.col(c).alias(f"a_{c}") for c in keys], "slot", "value")
    two = rows.select(*[F.col(c).alias(f"b_{c}") for c in keys], "slot", "value")
    return one.join(two, ["slot", "value"]).filter(F.struct(*[f"a_{c}" for c in keys]) < F.struct(*[f"b_{c}" for c in keys]))


def slot_agreements(sigs: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(a, b, slot, value) of all pairs of classes of equal signatures, and of each class with its other members.

    A class is named by its least id; what holds for it holds for its members, so copies cost no pairs of their own.
    """
    sigs = checkpointed(sigs)
    classes = sigs.groupBy("sig").agg(F.min(id_col).alias("id"))
    pairs = agreements(classes.select("id", F.posexplode("sig").alias("slot", "value"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "slot", "value")
    copies = sigs.select(F.col(id_col).alias("b"), "sig").join(classes.withColumnRenamed("id", "a"), "sig").filter("a <> b")
    return pairs.union(copies.select("a", "b", F.posexplode("sig").alias("slot", "value")))


def object_groups(values: DataFrame) -> DataFrame:
    """(seq_id, slot, value, class, n_links): with how many others a sequence shares the value of each slot, and the least id of them all.

    All pairs that agree in a slot, as groups: any two rows of one slot and value are a pair.
    """
    values = checkpointed(values.select("seq_id", "slot", "value"))
    groups = values.groupBy("slot", "value").agg(F.min("seq_id").alias("class"), (F.count("*") - 1).alias("n_links"))
    return values.join(groups, ["slot", "value"]).select("seq_id", "slot", "value", "class", "n_links")


#: Groups of up to so many signatures are compared many groups at a time.
FEW = 24
#: Groups of up to so many signatures are compared all with all; larger ones are split.
DIRECT = 1 << 12
#: Numbers of equal slots up to this are counted by bytes, larger ones, which few pairs have, one by one.
OFTEN = 6
#: Cells of the table of frequent values of all signatures, or of a large group, at most.
CELLS = 1 << 20
#: Signatures of one bucket of values of a slot, about.
BUCKET = 1 << 15


def _lags(values: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``_solved`` of many small groups, rows in order of their groups."""
    n, m = values.shape
    out = np.zeros((n, m + 1), np.int64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    other = np.where(values < 0, -2, values)
    for lag in range(1, int(sizes.max(initial=1))):
        x = np.flatnonzero(group[lag:] == group[:-lag])
        y = x + lag
        equal = np.count_nonzero(values[x] == other[y], axis=1)
        out[x, equal] += weight[y]
        out[y, equal] += weight[x]
    return out


def _direct(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``_solved`` by a comparison of all rows with all, a tile of bytes at a time."""
    order = np.argsort(-weight, kind="stable")  # those of a weight above 1 come first
    values, weight = values[order], weight[order]
    n, m = values.shape
    out = np.zeros((n, m + 1), np.int64)
    slots = []
    for v in values.T[(values >= 0).any(axis=0)]:
        if n > 128 and v.max() < 8 * n:
            # Only values of two rows or more are compared, as bytes if there are few.
            often = np.bincount(v + 1) > 1
            often[0] = False
            if not often.any():
                continue
            v = np.where(often, often.cumsum() - 1, -1)[v + 1]
        kind = next(k for k in (np.uint8, np.uint16, np.uint32) if v.max() < np.iinfo(k).max - 1)
        blank = np.iinfo(kind).max
        slots.append((np.where(v < 0, blank, v).astype(kind)[:, None], np.where(v < 0, blank - 1, v).astype(kind)))
    wide, high = 255 * 8, 255 if n <= 510 else 96

    def compared(rows: slice, cols: slice) -> np.ndarray:
        """Equal slots; the columns are filled up to words of eight."""
        size, width = rows.stop - rows.start, cols.stop - cols.start
        equal, same = np.zeros((size, -(-width // 8) * 8), np.uint8), np.empty((size, width), bool)
        for x, y in slots:
            np.equal(x[rows], y[cols], out=same)
            equal[:, :width] += same.view(np.uint8)
        return equal

    if n <= 128:
        place = compared(slice(0, n), slice(0, n))[:, :n] + np.arange(n)[:, None] * (m + 1)
        out += np.bincount(place.ravel(), np.tile(weight, n), n * (m + 1)).astype(np.int64).reshape(n, m + 1)
    for top in range(0, n if n > 128 else 0, high):
        rows = slice(top, min(n, top + high))
        size = rows.stop - top
        for left in range(top, n, wide):
            cols = slice(left, min(n, left + wide))
            width, after = cols.stop - left, size if left == top else 0  # both orders of the pairs of the own rows are there
            equal = compared(rows, cols)
            same = np.empty(equal.shape, bool)
            most = int(equal.max())
            for e in range(1, min(most, OFTEN) + 1):
                np.equal(equal, e, out=same)
                words = same.view(np.uint64)
                # Eight counts in a word: of up to 255 words or rows none overflows its byte.
                out[rows, e] += words.sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(size, 8).sum(axis=1, dtype=np.int64)
                out[left + after : cols.stop, e] += words.sum(axis=0, dtype=np.uint64).view(np.uint8)[after:width]
            if most > OFTEN:
                np.greater(equal, OFTEN, out=same)
                at = np.flatnonzero(same)
                e, (row, col) = equal.ravel()[at], np.divmod(at, equal.shape[1])
                out[rows] += np.bincount(row * (m + 1) + e, minlength=size * (m + 1)).reshape(size, m + 1)
                out[left : cols.stop] += np.bincount((col * (m + 1) + e)[col >= after], minlength=width * (m + 1)).reshape(width, m + 1)
    copies = int(np.count_nonzero(weight > 1)) if n > 128 else 0
    for left in range(0, copies, wide):
        cols = slice(left, min(copies, left + wide))
        more = weight[cols] - 1
        for top in range(0, n, high):
            rows = slice(top, min(n, top + high))
            size = rows.stop - top
            place = compared(rows, cols)[:, : len(more)] + np.arange(size)[:, None] * (m + 1)
            out[rows] += np.bincount(place.ravel(), np.tile(more, size), size * (m + 1)).astype(np.int64).reshape(size, m + 1)
    # Each row met itself, in the slots that were compared.
    out[np.arange(n), sum((x[:, 0] == y for x, y in slots), np.zeros(n, np.int64))] -= weight
    out[:, 0] = weight.sum() - weight - out[:, 1:].sum(axis=1)
    back = np.empty_like(out)
    back[order] = out
    return back


def _table(place: np.ndarray, sizes: list[int], weight: np.ndarray) -> np.ndarray:
    """Of each row, by equal slots: the weights of all rows, itself included.  ``place`` numbers the values of each slot, 0 equals nothing.

    All cells of a table with one axis for each slot are summed slot by slot.
    """
    axes = [j for j, d in enumerate(sizes) if d > 1]
    cell = np.zeros(len(place), np.int64)
    for j in axes:
        cell = cell * sizes[j] + place[:, j]
    total = math.prod(sizes)
    kind = np.int32 if weight.sum() < 1 << 31 else np.int64
    sums = np.bincount(cell, weight, total).astype(kind).reshape(1, total)
    inner = total
    for n_done, j in enumerate(axes):
        inner //= sizes[j]
        was = sums.reshape(n_done + 1, -1, sizes[j], inner)
        sums = np.zeros((n_done + 2, *was.shape[1:]), kind)
        sums[:-1] = was.sum(axis=2, keepdims=True, dtype=kind)
        sums[:-1, :, 1:] -= was[:, :, 1:]
        sums[1:, :, 1:] += was[:, :, 1:]
    out = np.zeros((len(place), place.shape[1] + 1), np.int64)
    out[:, : len(axes) + 1] = sums.reshape(len(axes) + 1, total)[:, cell].T
    return out


def _frequent(counts: list[tuple[int, int, int]], m: int, cells: int) -> list[list[int]]:
    """Of each slot the values for a table of up to ``cells``, from (rows, slot, value), the most frequent first."""
    chosen: list[list[int]] = [[] for _ in range(m)]
    total = 1
    for _, slot, value in counts:
        grown = total // (len(chosen[slot]) + 1) * (len(chosen[slot]) + 2)
        if grown <= cells:
            total = grown
            chosen[slot].append(value)
    return chosen


def _grouped(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their groups, and the groups' sizes, without groups of one."""
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    sizes = np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])) if len(key) else np.zeros(0, np.int64)
    return rows[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]


def _solved(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each row, by the number of equal slots from 0 on: the weights of all other rows.  Values below 0 equal nothing.

    Large groups are split.  Agreements in the most frequent values of each slot are counted for all rows by ``_table``.  As a
    polynomial in t, each other row is the product of t for an equal slot and 1 for another; t = 1 + (t - 1) in a slot of a rarer
    value, so the rows with that value in the slot add t - 1 times their own counts over the frequent values and the slots after it.
    """
    n, m = values.shape
    if n <= DIRECT:
        return _direct(values, weight)
    full = np.count_nonzero(values >= 0, axis=1)
    whole = np.ascontiguousarray(values.astype(np.int32))
    _, first, nth = np.unique(whole.view(np.dtype((np.void, 4 * m))).ravel(), return_index=True, return_inverse=True)
    if len(first) < n:
        total = np.bincount(nth, weight).astype(np.int64)
        out = (_solved(values[first], total) if len(first) > 1 else np.zeros((1, m + 1), np.int64))[nth]
        out[np.arange(n), full] += total[nth] - weight
        return out
    counts = [np.bincount(values[:, j] + 1)[1:] for j in range(m)]
    top = sorted(((int(c[v]), j, int(v)) for j, c in enumerate(counts) for v in np.flatnonzero(c >= DIRECT // 16)), reverse=True)
    chosen = _frequent(top, m, min(CELLS, 2 * n))
    place, rare = np.zeros((n, m), np.int64), 0
    for j, c in enumerate(counts):
        number = np.zeros(len(c) + 1, np.int64)  # the last for values below 0
        number[chosen[j]] = np.arange(1, len(chosen[j]) + 1)
        place[:, j] = number[values[:, j]]
        rare += int((c.astype(np.int64) ** 2).sum() - (c[chosen[j]].astype(np.int64) ** 2).sum())
    if 2 * rare > n * n:
        return _direct(values, weight)
    out = _table(place, [len(c) + 1 for c in chosen], weight)
    out[np.arange(n), np.count_nonzero(place, axis=1)] -= weight
    kept = np.where(place > 0, values, -1)
    for j in range(m):
        rows = np.flatnonzero((place[:, j] == 0) & (values[:, j] >= 0))
        rows, sizes = _grouped(rows, values[rows, j])
        if len(rows):
            _add(out, rows, _each(np.concatenate([kept[rows, :j], values[rows, j + 1 :]], 1), weight[rows], sizes))
    return out


def _add(out: np.ndarray, rows: np.ndarray, part: np.ndarray) -> None:
    """Adds t - 1 times ``part``."""
    size = part.shape[1]
    out[rows, :size] -= part
    out[rows, 1 : size + 1] += part


def _each(values: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``_solved`` of each group of rows in order."""
    out = np.empty((len(values), values.shape[1] + 1), np.int64)
    few = sizes <= FEW
    rows = np.repeat(few, sizes)
    if few.any():
        out[rows] = _lags(values[rows], weight[rows], sizes[few])
    start = sizes.cumsum() - sizes
    for i, size in zip(start[~few].tolist(), sizes[~few].tolist(), strict=True):
        out[i : i + size] = _solved(values[i : i + size], weight[i : i + size])
    return out


def _numbered(rows: pa.Table) -> np.ndarray:
    """Signatures with the values of each slot numbered from 0."""
    sig = _matrix(rows)
    return np.stack([pa.array(np.ascontiguousarray(sig[:, j])).dictionary_encode().indices.to_numpy() for j in range(sig.shape[1])], 1)


def link_counts(sigs: DataFrame, m: int, keys: tuple[str, ...] = ("seq_id",), apart: str | None = None) -> DataFrame:
    """(keys, class_keys, n_links, n_1 to n_m): of each signature, how many others agree with it in 1 to ``m`` slots.

    All pairs count, copies too, and those of two members of any two classes; with ``apart`` rows of one value of that column do
    not link.  The class is the least key with an equal signature.  No pairs are made and equal signatures are counted once:
    agreements in frequent values come from one table of at most ``CELLS`` cells, and for each rarer value the signatures that have
    it meet in a task, as told at ``_solved``.  Pairs within a value of ``apart`` are counted by themselves and taken off.
    """
    if m > 255:
        raise ValueError("m must be at most 255")
    sigs = _short(checkpointed(sigs.select(*keys, "sig")))
    named = [f"class_{c}" for c in keys] if len(keys) > 1 else ["class"]
    classes = sigs.groupBy("sig").agg(F.min(F.struct(*keys)).alias("_c"), F.count("*").alias("_w"))
    units = checkpointed(classes.withColumn("_unit", F.monotonically_increasing_id()))
    n_units = units.count()
    slots = units.select("_unit", "_w", "sig", F.posexplode("sig").alias("_slot", "_value"))
    counts = slots.groupBy("_slot", "_value").count().filter(F.col("count") > DIRECT)
    top = [(r["count"], r["_slot"], r["_value"]) for r in counts.orderBy(F.desc("count"), "_slot", "_value").limit(4096).collect()]
    chosen = _frequent(top, m, CELLS)
    places = [F.coalesce(*[F.when(F.col("sig")[j] == v, i) for i, v in enumerate(own, 1)], F.lit(0)) for j, own in enumerate(chosen)]
    cell = reduce(lambda x, j: x * (len(chosen[j]) + 1) + places[j], range(m), F.lit(0))
    sizes = [len(own) + 1 for own in chosen]
    names = [f"_s{i}" for i in range(m + 1)]
    counted = ", ".join(f"{x} long" for x in names)
    buckets = max(8, -(-n_units // BUCKET))

    def table(rows: pa.Table) -> pa.Table:
        cells, place = rows.column("_cell").to_numpy(), np.zeros((len(rows), m), np.int64)
        for j in range(m - 1, -1, -1):
            cells, place[:, j] = np.divmod(cells, sizes[j])
        out = _table(place, sizes, rows.column("_w").to_numpy())
        return pa.table({"_cell": rows.column("_cell")} | dict(zip(names, out.T, strict=True)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        slot, sig, values = key[0].as_py(), _matrix(rows), _numbered(rows)
        for j in range(slot):
            values[~np.isin(sig[:, j], chosen[j]), j] = -1
        order, groups = _grouped(np.arange(len(rows)), values[:, slot])
        out = np.zeros((len(order), m + 1), np.int64)
        part = _each(np.delete(values[order], slot, 1), rows.column("_w").to_numpy()[order], groups)
        _add(out, np.arange(len(order)), part)
        return pa.table({"_unit": rows.column("_unit").take(pa.array(order))} | dict(zip(names, out.T, strict=True)))

    def within(rows: pa.Table) -> pa.Table:
        values, code = _numbered(rows), pa.compute.rank(rows.column("_own"), tiebreaker="min").to_numpy()
        order, groups = _grouped(np.arange(len(rows)), code)
        out = _each(values[order], rows.column("_w").to_numpy()[order], groups)
        rows = rows.take(pa.array(order))
        return pa.table({"_u": rows.column("_unit"), "_v": rows.column("_own")} | dict(zip((f"_o{i}" for i in range(m + 1)), out.T, strict=True)))

    parts = []
    if max(sizes, default=1) > 1:
        met = reduce(lambda x, y: x + (y > 0).cast("int"), places, F.lit(0))
        placed = checkpointed(units.select("_unit", "_w", cell.alias("_cell"), met.alias("_met")))
        by_cell = placed.groupBy("_cell").agg(F.sum("_w").alias("_w")).groupBy().applyInArrow(table, "_cell int, " + counted)
        # The table counts a row with itself.
        parts.append(placed.join(by_cell, "_cell").select("_unit", *[(F.col(x) - F.when(F.col("_met") == i, F.col("_w")).otherwise(0)).alias(x) for i, x in enumerate(names)]))
    frequent = F.lit(False)
    for j, own in enumerate(chosen):
        if own:
            frequent = frequent | ((F.col("_slot") == j) & F.col("_value").isin(own))
    dealt = slots.filter(~frequent).withColumn("_part", F.pmod(F.xxhash64("_value"), F.lit(buckets)))
    dealt = dealt.select("_unit", "_w", "sig", "_slot", "_part")
    parts.append(dealt.groupBy("_slot", "_part").applyInArrow(run, "_unit long, " + counted))
    sums = reduce(DataFrame.union, parts).groupBy("_unit").agg(*[F.sum(x).alias(x) for x in names[1:]])
    rows = sigs.join(units, "sig").join(sums, "_unit", "left")
    n = {j: F.coalesce(f"_s{j}", F.lit(0)).cast("long") for j in range(1, m + 1)}
    n[m] = n[m] + F.col("_w") - 1
    if apart:
        own = sigs.groupBy("sig", F.col(apart).alias("_own")).agg(F.count("*").alias("_w"))
        own = checkpointed(own.join(units.select("sig", "_unit"), "sig"))
        schema = f"_u long, _v {dict(sigs.dtypes)[apart]}, " + ", ".join(f"_o{i} long" for i in range(m + 1))
        pairs = own.groupBy(F.pmod(F.xxhash64("_own"), F.lit(buckets)).alias("_part")).applyInArrow(within, schema)
        copies = own.select("_unit", "_own", (F.col("_w") - 1).alias("_more"))
        pairs = copies.join(pairs, (F.col("_unit") == F.col("_u")) & F.col("_own").eqNullSafe(F.col("_v")), "left").drop("_u", "_v")
        pairs = pairs.withColumnRenamed("_unit", "_u")
        rows = rows.join(pairs, (F.col("_unit") == F.col("_u")) & F.col(apart).eqNullSafe(F.col("_own")))
        n = {j: n[j] - F.coalesce(f"_o{j}", F.lit(0)) - (F.col("_more") if j == m else 0) for j in n}
    links = sum(n.values(), F.lit(0).cast("long"))
    return rows.select(*keys, *[F.col("_c")[c].alias(x) for c, x in zip(keys, named, strict=True)], links.alias("n_links"), *[n[j].alias(f"n_{j}") for j in range(1, m + 1)])


#: Signatures of a block of an exact comparison, so that a task holds two blocks at a time.
BLOCK = 1 << 17
#: A value that more than 1 in so many rows of a block have in a slot is kept as a byte for each row.
DENSE = 32
#: Pairs that a comparison of two blocks holds beside the best of each row.
HELD = 1 << 20
#: Query rows whose lists are looked up at a time.
ROWS = 1 << 12


def blocks_for(n: int) -> int:
    """Number of blocks for ``n`` signatures; from 8 on, each holds about ``BLOCK`` of them."""
    return max(8, -(-n // BLOCK))


class _Lists:
    """Of each slot, the rows of a block by value."""

    def __init__(self, base: np.ndarray):
        self.n, self.m = base.shape
        order = np.argsort(base, axis=0, kind="stable")
        self.values = [base[order[:, j], j] for j in range(self.m)]
        self.rows = np.ascontiguousarray(order.T).ravel()
        self.kind = np.uint8 if self.m < 256 else np.uint32
        self.dense: dict[int, np.ndarray] = {}

    def _dense(self, x: int, y: int) -> np.ndarray:
        if x not in self.dense:
            self.dense[x] = np.zeros(self.n, self.kind)
            self.dense[x][self.rows[x:y]] = 1
        return self.dense[x]

    def agreements(self, query: np.ndarray):
        """Of each query row in turn: (rows, equal slots with each), or (None, equal slots with every row)."""
        many = self.n // DENSE
        for i in range(0, len(query), ROWS):
            part = query[i : i + ROWS]
            begin, end = (np.stack([np.searchsorted(v, part[:, j], side) + j * self.n for j, v in enumerate(self.values)], 1) for side in ("left", "right"))
            for spans in zip(begin.tolist(), end.tolist(), strict=True):
                few = [self.rows[x:y] for x, y in zip(*spans, strict=True) if x < y <= x + many]
                often = [(x, y) for x, y in zip(*spans, strict=True) if y > x + many]
                rows = np.concatenate(few) if few else self.rows[:0]
                if not often and len(rows) <= many:
                    rows.sort()
                    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
                    yield rows[first], np.diff(first, append=len(rows))
                    continue
                count = np.bincount(rows, minlength=self.n).astype(self.kind)
                for span in often:
                    count += self._dense(*span)
                yield None, count


def _best(at: np.ndarray, to: np.ndarray, equal: np.ndarray, n: int, m: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each ``at``, the ``top`` of ``to`` (less than ``n``) with most equal slots of ``m``; on a tie the first."""
    key = np.sort((at.astype(np.int64) * (m + 1) + (m - equal.astype(np.int64))) * n + to)
    at = key // (n * (m + 1))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    rank = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    key, at = key[rank < top], at[rank < top]
    return at, key % n, m - key // n % (m + 1)


def _first(count: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest; on a tie the first."""
    upwards = np.bincount(count)[::-1].cumsum()[::-1]
    least = int(np.count_nonzero(upwards >= top)) - 1
    over = np.flatnonzero(count > least)
    return np.concatenate([over, np.flatnonzero(count == least)[: top - len(over)]])


def _joined(found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, to, equal = zip(*found, strict=True)
    return np.repeat(at, [len(z) for z in to]), np.concatenate(to), np.concatenate(equal)


def _nearest_within(base: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, equal slots) of the ``top`` other rows of each row with an equal slot; on a tie the first."""
    n, m = base.shape
    found = []
    for i, (rows, count) in enumerate(_Lists(base).agreements(base)):
        if rows is None:
            count[i] = 0
            # The ``top``-th among some rows has no more than that among all.
            upwards = np.bincount(count[::8], minlength=m + 1)[:0:-1].cumsum()[::-1]
            rows = np.flatnonzero(count >= max(1, int(np.count_nonzero(upwards >= top))))
            count = count[rows]
        else:
            rows, count = rows[rows != i], count[rows != i]
        if len(rows) > top:
            pick = _first(count, top)
            rows, count = rows[pick], count[pick]
        found.append((i, rows, count))
    return _best(*_joined(found), n, m, top)


def _nearest_across(x: np.ndarray, y: np.ndarray, least_x: np.ndarray, least_y: np.ndarray, top: int):
    """Two results as of ``_nearest_within``: for rows of ``x`` those of ``y``, and the reverse; each pair is compared once.

    Only pairs with at least as many equal slots as the row's number in ``least_x`` or ``least_y`` count.  No more than ``HELD``
    pairs and ``top`` for each row are held; a row of ``y`` that has its ``top`` takes only better ones of later rows of ``x``.
    """
    (n, m), n_x = y.shape, len(x)
    lists, floors, least_y = _Lists(y), {}, least_y.copy()
    none = [np.zeros(0, np.int64)] * 3
    own, back, own_new, back_new, held = [none], none, [], [], 0
    for i, (rows, count) in enumerate(lists.agreements(x)):
        t = int(least_x[i])
        if t not in floors:
            floors[t] = np.minimum(least_y, t).astype(lists.kind)
        pick = np.flatnonzero(count >= (floors[t] if rows is None else floors[t][rows]))
        count = count[pick]
        to = pick if rows is None else rows[pick]
        mine, its = np.flatnonzero(count >= t), np.flatnonzero(count >= least_y[to])
        if len(mine) > 8 * top:
            mine = mine[_first(count[mine], top)]
        own_new.append((i, to[mine], count[mine]))
        back_new.append((i, to[its], count[its]))
        held += len(mine) + len(its)
        if held > HELD or i == n_x - 1:
            own.append(_best(*_joined(own_new), n, m, top))
            i_x, i_y, equal = _joined(back_new)
            back = _best(*map(np.concatenate, zip(back, (i_y, i_x, equal), strict=True)), n_x, m, top)
            full = np.flatnonzero(np.bincount(back[0], minlength=n) >= top)
            last = np.searchsorted(back[0], full, "right") - 1
            least_y[full] = np.maximum(least_y[full], back[2][last] + 1)
            floors, own_new, back_new, held = {}, [], [], 0
    return tuple(map(np.concatenate, zip(*own, strict=True))), back


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _short(sigs: DataFrame) -> DataFrame:
    """Signatures as ints where all values are."""
    if dict(sigs.dtypes)["sig"] == "array<bigint>":
        low, high = sigs.agg(F.min(F.array_min("sig")), F.max(F.array_max("sig"))).first()
        if low is not None and -(1 << 31) <= low and high < 1 << 31:
            return sigs.withColumn("sig", F.col("sig").cast("array<int>"))
    return sigs


def nearest(sigs: DataFrame, top: int, id_col: str = "seq_id", blocks: int = 8) -> DataFrame:
    """(a, b, sim, rank): the ``top`` most similar partners of each signature among all that agree in a slot.

    Exact: classes are dealt to ``blocks`` blocks.  Each block is compared with itself, and then every pair of blocks once, in one
    task for both directions, by lists of the rows with each value of a slot; there only pairs count that are no worse than the
    ``top``-th of the own block.  A row is sent ``blocks`` times.  Equal signatures are compared once, as one class named by
    its least id; partners are classes.
    """
    classes = sigs.groupBy("sig").agg(F.min(id_col).alias("id"))
    classes = checkpointed(classes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    kind = sigs.schema[id_col].dataType.simpleString()
    classes = _short(classes)

    def found(ids: tuple[pa.ChunkedArray, pa.ChunkedArray], m: int, at: np.ndarray, to: np.ndarray, equal: np.ndarray) -> pa.Table:
        return pa.table({"a": ids[0].take(pa.array(at)), "b": ids[1].take(pa.array(to)), "sim": pa.array(equal / m), "equal": pa.array(equal, pa.int32())})

    def within(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, sig = rows.column("id"), _matrix(rows)
        return found((ids, ids), sig.shape[1], *_nearest_within(sig, top))

    def across(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, block, least, sig = rows.column("id"), rows.column("block").to_numpy(), rows.column("least").to_numpy(), _matrix(rows)
        x, y = np.flatnonzero(block == block.min()), np.flatnonzero(block > block.min())
        if not len(y):
            return found((ids, ids), sig.shape[1], *[np.zeros(0, np.int64)] * 3)
        x_ids, y_ids = ids.take(pa.array(x)), ids.take(pa.array(y))
        own, back = _nearest_across(sig[x], sig[y], least[x], least[y], top)
        return pa.concat_tables([found((x_ids, y_ids), sig.shape[1], *own), found((y_ids, x_ids), sig.shape[1], *back)])

    schema = f"a {kind}, b {kind}, sim double, equal int"
    own = checkpointed(classes.repartition(4 * blocks, "block").groupBy("block").applyInArrow(within, schema))
    # The ``top``-th partner in the own block: a worse one of another block is not among the ``top`` of all.
    least = own.groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= top, F.min("equal")).otherwise(1).alias("least"))
    dealt = classes.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).filter("block <> other")
    dealt = dealt.select("id", "sig", "block", "least", (F.least("block", "other") * blocks + F.greatest("block", "other")).alias("part"))
    other = dealt.repartition(blocks * blocks, "part").groupBy("part").applyInArrow(across, schema)
    ranked = own.union(other).withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("equal"), "b")))
    return ranked.filter(F.col("rank") <= top).drop("equal")


def memberships(sigs: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(id, class): of each signature, the least id with an equal one."""
    named = sigs.groupBy("sig").agg(F.min(id_col).alias("class"))
    return sigs.select(F.col(id_col).alias("id"), "sig").join(named, "sig").select("id", "class")


def nearest_with_members(sigs: DataFrame, top: int, id_col: str = "seq_id", blocks: int = 8) -> DataFrame:
    """``nearest``, and for each signature one row of rank 0 and similarity 1 from its id to its class.

    The signatures are made once and kept in the shared folder.
    """
    sigs = checkpointed(sigs)
    member = memberships(sigs, id_col).select(F.col("id").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("sim"), F.lit(0).alias("rank"))
    return nearest(sigs, top, id_col, blocks).union(member)


def neighbours(sigs: DataFrame, bands: int, top: int, id_col: str = "seq_id") -> DataFrame:
    """(a, b, sim, rank): the ``top`` most similar partners of each signature among band matches.

    Signatures meet if they agree on all slots of a band: an equi-join on (band, hash), not a cross join.
    Equal signatures are compared once, as one class named by its least id, so a large group of copies
    costs no pairs of its own; partners are classes.
    """
    classes = sigs.groupBy("sig").agg(F.min(id_col).alias("id"))
    m = F.size("sig")
    rows = F.floor(m / bands)
    keyed = classes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    keyed = keyed.select("id", "sig", "band", F.xxhash64("band", F.slice("sig", (F.col("band") * rows + 1).cast("int"), rows.cast("int"))).alias("key"))
    left, right = keyed.alias("l"), keyed.alias("r")
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.id") != F.col("r.id")))
    # A pair is judged in its first common band only.
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.slice(F.col("l.sig"), (b * F.floor(F.size("l.sig") / bands) + 1).cast("int"), F.floor(F.size("l.sig") / bands).cast("int")) == F.slice(F.col("r.sig"), (b * F.floor(F.size("r.sig") / bands) + 1).cast("int"), F.floor(F.size("r.sig") / bands).cast("int"))), True) - 1
    pairs = met.filter(first == F.col("l.band")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), slot_similarity(F.col("l.sig"), F.col("r.sig")).alias("sim"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.filter(F.col("rank") <= top)
