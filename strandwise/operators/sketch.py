"""Similarity sketches of k-mer sets and multisets.

Bottom-k sketches, one-permutation bins and the exponential race have forms as DataFrame expressions, for any hash.  The sketch
kernels run in Arrow batches over whole sequences: a signature needs its sequence only, so they are one
map pass after the sequences are spread over the cores.  One signature for many sequences merges partial ones slot by slot.

Algorithms from the papers: SuperMinHash (arXiv:1706.05698), ProbMinHash3 in the order of its variant 3a
(arXiv:1911.00675), P-MinHash's exponential race as a DataFrame form, optimal densification (Shrivastava 2017) and its reverse (Mai and others 2020),
SetSketch (arXiv:2101.00314).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions.hashing import inv32, inv32_of, inv64, mix64
from .kmers import kmers, spread

#: Golden-ratio step between the slots of the exponential race (a fixed value).
SLOT_STEP = 2654435769
#: SetSketch: base, rate and number of registers' values.
SET_B, SET_A, SET_Q = 1.001, 20.0, (1 << 16) - 2


@dataclass(frozen=True)
class SketchParams:
    """What a signature was made with; stored beside it as JSON."""

    kmer_size: int
    sketch_size: int
    algo: str = "PROB3A"
    data_type: str = "DNA"

    def __post_init__(self):
        if self.algo not in KERNELS and self.algo != "BOTTOMK":
            raise ValueError(f"unknown algorithm {self.algo}")
        if self.data_type not in ("DNA", "AA"):
            raise ValueError(f"unknown data type {self.data_type}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> SketchParams:
        return cls(**json.loads(text))


# --- DataFrame forms -------------------------------------------------------------------------------------


def code_hash(kmer: Column) -> Column:
    """Default hash of a k-mer of up to 16 bases: the 32-bit mix of its code."""
    return inv32(A.kmer_code(kmer))


def bottom_k(rows: DataFrame, size: int, hash_col: Column, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(keys, rank, hash, cnt): the ``size`` smallest distinct hashes of each group with their multiplicity.

    The rank filter becomes a window group limit, which keeps ``size`` rows of a group before the shuffle.
    """
    counted = rows.select(*keys, hash_col.alias("hash")).groupBy(*keys, "hash").agg(F.count("*").alias("cnt"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("hash")))
    return ranked.filter(F.col("rank") <= size).select(*keys, "rank", "hash", "cnt")


def code_hash64(kmer: Column) -> Column:
    """The 64-bit mix of a k-mer's code, as a signed long."""
    return inv64(A.kmer_code(kmer))


def _array_hash(hash_fn: Callable[[Column], Column], k: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """The same hash of an array of codes, as signed longs, where there is one."""
    if hash_fn is code_hash and k <= 16:
        return lambda codes: inv32_of(codes).view(np.int64)
    return (lambda codes: mix64(codes).view(np.int64)) if hash_fn is code_hash64 and k <= 31 else None


def together(seqs: DataFrame) -> DataFrame:
    """(seq_id, seqs): the sequences of each id, dealt over all shuffle partitions."""
    return spread(seqs.select("seq_id", "seq")).groupBy("seq_id").agg(F.collect_list("seq").alias("seqs"))


#: Sequences that a kernel takes at once.
TOGETHER = 256


def _per_id(seqs: DataFrame, k: int, aa: bool, canonical: bool, make: Callable, schema: str) -> DataFrame:
    """Rows (seq_id, further fields by ``make``) from the k-mers of all sequences of each id.

    ``make`` takes codes, numbers of ids in order, places in the sequence and lengths of the sequences, and gives numbers
    of ids and the further columns.
    """
    kind = seqs.schema["seq_id"].dataType.simpleString()
    names = ["seq_id"] + [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b.slice(at, TOGETHER)
                texts = part.column(1).to_pylist()
                each = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
                flat = [s for x in texts for s in x]
                codes, owner, place = batch_codes(flat, k, aa, canonical)
                if len(codes):
                    ids, *more = make(codes, each[owner], place, np.array([len(s) for s in flat], np.int64)[owner])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids)), *[x if isinstance(x, pa.Array) else pa.array(x) for x in more]], names=names)

    return together(seqs).mapInArrow(run, f"seq_id {kind}, {schema}")


def _least(group: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, rank, value, count) of the ``size`` least distinct values of each group."""
    order = np.lexsort((value, group)) if len(value) and (value.min() < 0 or value.max() > 0xFFFFFFFF or group.max() >> 31) else np.argsort(group << 32 | value)
    group, value = group[order], value[order]
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(value)])
    group, value = group[new], value[new]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(new) else new
    rank = np.arange(len(new)) - np.repeat(first, np.diff(np.r_[first, len(new)])) + 1
    keep = rank <= size
    return group[keep], rank[keep].astype(np.int32), value[keep], count[keep]


def minhash(seqs: DataFrame, k: int, size: int, hash_fn: Callable[[Column], Column] = code_hash, begin: int = 0, end: int | None = None) -> DataFrame:
    """Bottom-k sketch of the canonical k-mers of each sequence, or of a range of it.

    The integer hashes are made in Arrow batches, where a sketch needs its sequence only; other hashes by expressions.
    """
    hashed = _array_hash(hash_fn, k)
    if hashed is None:
        return bottom_k(kmers(seqs, k, True, begin, end), size, hash_fn(F.col("kmer")))

    def make(codes, owner, place, length):
        if begin or end is not None:
            own = (place >= begin) & (place + k <= (np.iinfo(np.int64).max if end is None else end))
            codes, owner = codes[own], owner[own]
        return _least(owner, hashed(codes), size)

    return _per_id(seqs, k, False, True, make, "rank int, hash long, cnt long")


def slice_sketch(seqs: DataFrame, k: int, window: int, overlap: int, size: int, hash_fn: Callable[[Column], Column] = code_hash, exclude_last: bool = True) -> DataFrame | None:
    """(seq_id, slicepos, rank, hash, cnt): ``minhash`` of each hopping slice; None for a hash that has no form for arrays."""
    hashed, step = _array_hash(hash_fn, k), window - overlap
    if hashed is None:
        return None
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and below window")

    def make(codes, owner, place, length):
        last, found = place + k <= length - int(exclude_last), []
        for back in range(-(-window // step)):  # slices that begin so many steps before the k-mer's own
            at = place // step - back
            own = last & (at >= 0) & (place + k <= at * step + window)
            found.append((owner[own], at[own], codes[own]))
        owner, at, codes = (np.concatenate(x) for x in zip(*found, strict=True))
        wide = int(at.max(initial=0)) + 1
        group, rank, value, count = _least(owner * wide + at, hashed(codes), size)
        return group // wide, (group % wide).astype(np.int32), rank, value, count

    return _per_id(seqs, k, False, True, make, "slicepos int, rank int, hash long, cnt long")


def bin_minima(seqs: DataFrame, k: int, m: int) -> DataFrame:
    """(seq_id, sig): the least 32-bit hash of each of ``m`` bins, all ones where a bin is empty; for sequences that have a k-mer."""
    if k > 16:
        raise ValueError("codes of up to 16 bases have a 32-bit hash")

    def make(codes, owner, place, length):
        ids, nth = np.unique(owner, return_inverse=True)
        h = inv32_of(codes).view(np.int64)
        out = np.full(len(ids) * m, 0xFFFFFFFF, np.int64)
        np.minimum.at(out, nth * m + h % m, h)
        return ids, _lists(out.reshape(-1, m))

    return _per_id(seqs, k, False, True, make, "sig array<long>")


def race(weights: DataFrame, m: int, keys: tuple[str, ...] = ("seq_id",), hash_fn: Callable[[Column], Column] = A.kmer_code) -> DataFrame:
    """(keys, slot, value): in each slot the code with the earliest arrival of an exponential race.

    Arrival times are -ln(u(code, slot)) / weight, so two multisets agree in a slot with the probability
    Jaccard index.  Rows for the slots arise by an explode and are combined before the shuffle.
    """
    coded = weights.select(*keys, hash_fn(F.col("kmer")).alias("code"), "weight").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    z = (F.col("code") + F.col("slot").cast("long") * SLOT_STEP).bitwiseAND(F.lit(0xFFFFFFFF))
    u = (inv32(z) + 0.5) / F.lit(4294967296.0)
    timed = coded.select(*keys, "slot", "code", (-F.log(u) / F.col("weight")).alias("time"))
    return timed.groupBy(*keys, "slot").agg(F.min_by("code", F.struct("time", "code")).alias("value"))


def one_permutation_bins(seqs: DataFrame, k: int, m: int, canonical: bool = True) -> DataFrame:
    """(seq_id, slot, value): the least hash in each non-empty bin, bin = hash modulo m."""
    rows = kmers(seqs, k, canonical).select("seq_id", code_hash(F.col("kmer")).alias("h"))
    return rows.groupBy("seq_id", (F.col("h") % m).cast("int").alias("slot")).agg(F.min("h").alias("value"))


# --- kernels ---------------------------------------------------------------------------------------------


def _letters(aa: bool) -> tuple[np.ndarray, int]:
    """Code of each byte, and bits of a code."""
    table = np.full(256, 255, np.uint64)
    for c, v in A.AMINO_CODES.items() if aa else zip("ACGT", range(4), strict=True):
        table[ord(c)] = v
    return table, 5 if aa else 2


def _windows(x: np.ndarray, k: int, bits: int, backwards: bool = False) -> np.ndarray:
    """Code of each window of ``k`` letters, put together from windows of 1, 2, 4, ... letters; ``backwards`` the last letter leads."""

    def put(head: np.ndarray, size: int, tail: np.ndarray, length: int) -> np.ndarray:
        head, tail = head[: len(head) - length], tail[size:]
        return (head | tail << np.uint64(bits * size)) if backwards else (head << np.uint64(bits * length) | tail)

    out, length, unit, size = None, 0, x, 1
    while True:
        if k & size:
            out, length = (unit, size) if out is None else (put(unit, size, out, length), length + size)
        if length == k:
            return out
        unit, size = put(unit, size, unit, size), 2 * size


def batch_codes(seqs: list[str], k: int, aa: bool, canonical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, number of its sequence, place in it) of all k-mers of several sequences, in order."""
    table, bits = _letters(aa)
    length = np.array([len(s) for s in seqs], np.int64)
    x = table[np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)]
    own = np.maximum(length - k + 1, 0)
    if not own.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(seqs)), own)
    place = np.arange(len(owner)) - np.repeat(own.cumsum() - own, own)
    at = place + (length.cumsum() - length)[owner]
    code = _windows(x, k, bits)
    if canonical:
        code = np.minimum(code, _windows(np.uint64(3) - x, k, bits, True))
    return code[at], owner, place


def _codes(seq: str, k: int, aa: bool, canonical: bool) -> np.ndarray:
    """Codes of all k-mers of a sequence, in order."""
    return batch_codes([seq], k, aa, canonical)[0]


def multiplicities(codes: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, owner, weight) of the distinct codes of ``bits`` bits of each owner, in order of both; owners come in order."""
    n = int(owner[-1]) + 1 if len(owner) else 0
    if bits + n.bit_length() < 64:
        key, weight = np.unique(owner.astype(np.uint64) << np.uint64(bits) | codes, return_counts=True)
        return key & np.uint64((1 << bits) - 1), (key >> np.uint64(bits)).astype(np.int64), weight
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if n else []
    found = [np.unique(c, return_counts=True) for c in np.split(codes, cuts[1:])] if n else []
    sizes = [len(c) for c, _ in found]
    return (np.concatenate([c for c, _ in found]), np.repeat(owner[cuts], sizes), np.concatenate([w for _, w in found])) if n else (codes, owner, owner)


#: Bases whose k-mers are held at once.
PIECE = 1 << 20


def weighted(texts: list[list[str]], k: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, owner, weight) of the distinct canonical k-mers of each list of sequences, in order of owner and code.

    About ``piece`` bases are taken at a time, and longer sequences in overlapping pieces, so that what is held are distinct k-mers.
    """
    found, now, own, size = [], [], [], 0

    def count() -> None:
        codes, owner, _ = batch_codes(now, k, False, True)
        found.append(multiplicities(codes, np.array(own, np.int64)[owner], 2 * k))

    for i, x in enumerate(texts):
        for s in x:
            for at in range(0, len(s) - k + 1, piece):
                now.append(s[at : at + piece + k - 1])
                own.append(i)
                size += len(now[-1])
                if size >= piece:
                    count()
                    now, own, size = [], [], 0
    if now or not found:
        count()
    code, owner, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        order = np.lexsort((code, owner))
        code, owner, weight = code[order], owner[order], weight[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])
        code, owner, weight = code[first], owner[first], np.add.reduceat(weight, first)
    return code, owner, weight


def _waits(code: np.ndarray, slot: int) -> np.ndarray:
    """Arrival times of an exponential race in one slot, at weight 1."""
    with np.errstate(over="ignore"):
        z = (code + np.uint64(slot * SLOT_STEP)) & np.uint64(0xFFFFFFFF)
    return -np.log((inv32_of(z) + 0.5) / 4294967296.0)


@lru_cache(maxsize=4)
def _all_waits(k: int, m: int) -> np.ndarray:
    """``_waits`` of every slot and code of ``k`` bases."""
    return np.stack([_waits(np.arange(1 << 2 * k, dtype=np.uint64), slot) for slot in range(m)])


def _winners(code: np.ndarray, owner: np.ndarray, weight: np.ndarray, m: int, k: int) -> np.ndarray:
    """The code with the earliest arrival in each slot of each owner, on a tie the least; owners are numbered from 0 and codes in order."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out = np.zeros((len(first), m), np.int64)
    weight, signed = weight.astype(float), code.view(np.int64)
    known = _all_waits(k, m) if m << 2 * k <= 1 << 20 else None
    for slot in range(m):
        time = (_waits(code, slot) if known is None else known[slot][signed]) / weight
        best = np.minimum.reduceat(time, first)
        won = np.flatnonzero(time == best[owner])[::-1]  # codes come in order, so that on a tie the least is put last
        out[owner[won], slot] = signed[won]
    return out


def word_codes(words: list[str], k: int, aa: bool) -> np.ndarray:
    """Codes of k-mers given as texts."""
    table, bits = _letters(aa)
    x = table[np.frombuffer("".join(words).encode("ascii"), np.uint8)].reshape(len(words), k)
    code = np.zeros(len(words), np.uint64)
    for i in range(k):
        code |= x[:, i] << np.uint64(bits * (k - 1 - i))
    return code


def code_words(codes: np.ndarray, k: int, aa: bool) -> list[str]:
    """Texts of k-mer codes."""
    table, bits = _letters(aa)
    back = np.zeros(1 << bits, np.uint8)
    known = np.flatnonzero(table != 255)
    back[table[known].astype(np.int64)] = known
    shifts = np.uint64(bits) * np.arange(k - 1, -1, -1, dtype=np.uint64)
    digits = (codes.astype(np.uint64)[:, None] >> shifts[None, :]) & np.uint64((1 << bits) - 1)
    text = back[digits.astype(np.int64)].tobytes().decode("ascii")
    return [text[i : i + k] for i in range(0, len(text), k)]


def _uniform(codes: np.ndarray, slots: np.ndarray, seed: int) -> np.ndarray:
    """u in (0, 1) of each (code, slot)."""
    with np.errstate(over="ignore"):
        h = mix64(mix64(codes)[:, None] ^ mix64(slots.astype(np.uint64) + np.uint64(seed))[None, :])
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _by_parts(codes: np.ndarray, m: int) -> Iterator[slice]:
    step = max(1, (1 << 20) // m)
    return (slice(k, k + step) for k in range(0, len(codes), step))


#: Points of a round of all elements, at most, unless there are more elements.
POINTS = 1 << 16


def first_points_by(codes: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, m: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of the earliest point in each slot of each of ``n`` owners: ProbMinHash3, all elements' points of a round at once.

    Element d has in each stretch [i, i + 1) / weight one point, at a truncated exponential place, in a slot
    drawn at random; so the first point in a slot is exponential at a rate in proportion to its weight.
    Elements whose next stretch begins beyond their owner's latest slot are done: about n + m log m points for each owner.
    A round has as many stretches as went before, while its points are few, as heavy elements have many stretches.
    """
    best, out = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    rate = np.log(m / (m - 1)) if m > 1 else 1.0
    i = 0
    while len(codes):
        turn = np.arange(i, i + max(1, min(i, POINTS // len(codes))))
        place, slot = _uniform(codes, turn, seed), np.repeat(owner * m, len(turn)).reshape(len(codes), -1)
        if m > 1:
            place = -np.log1p(-place / m) / rate
            slot = slot + np.minimum((_uniform(codes, turn, seed + 1000) * m).astype(np.int64), m - 1)
        else:
            place = -np.log(place)
        time = (turn + place) / weight[:, None]
        near = time < best[slot]
        time, slot, code = time[near], slot[near], codes[np.nonzero(near)[0]]
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        out[slot[won]] = code[won]
        i += len(turn)
        left = (i / weight < best.reshape(n, m).max(axis=1)[owner]) & (m > 1)
        codes, weight, owner = codes[left], weight[left], owner[left]
    return best.reshape(n, m), out.reshape(n, m)


def first_points(codes: np.ndarray, weight: np.ndarray, m: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of the earliest point in each slot of one weighted set."""
    best, out = first_points_by(codes, weight, np.zeros(len(codes), np.int64), 1, m, seed)
    return best[0], out[0]


def prob_kernel(codes: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash of the codes at their multiplicities.  Variant 3a is variant 3 in another order, with the same result."""
    distinct, weight = np.unique(codes, return_counts=True)
    return first_points(distinct, weight, m)[1].view(np.int64)


def prob_batch(codes: np.ndarray, owner: np.ndarray, n: int, m: int, bits: int) -> np.ndarray:
    """``prob_kernel`` of each of ``n`` owners' codes; zeros where an owner has none."""
    distinct, own, weight = multiplicities(codes, owner, bits)
    return first_points_by(distinct, weight, own, n, m)[1].view(np.int64)


def super_kernel(codes: np.ndarray, m: int, seed: int = 3) -> np.ndarray:
    """SuperMinHash: each element deals j + r_j (r_j uniform) to a random permutation of the slots; the least stays.

    Steps j of the permutations are made for all elements at once, and end when no slot holds more than j.
    """
    distinct = np.unique(codes)
    out = np.full(m, np.inf)
    for part in _by_parts(distinct, m):
        own = distinct[part]
        rows, perm = np.arange(len(own)), np.tile(np.arange(m, dtype=np.int32), (len(own), 1))
        for j in range(m):
            if out.max() <= j:
                break
            at = np.minimum(j + (_uniform(own, np.array([j]), seed)[:, 0] * (m - j)).astype(np.int64), m - 1)
            slot = perm[rows, at]
            perm[rows, at] = perm[:, j]
            np.minimum.at(out, slot, j + _uniform(own, np.array([j]), seed + 1000)[:, 0])
    return out


def super2_kernel(codes: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash in fixed-point integers: 32 bits of place, 31 of fraction."""
    out = super_kernel(codes, m, 5)
    return np.where(np.isinf(out), np.iinfo(np.int64).max, np.floor(np.where(np.isinf(out), 0, out) * (1 << 31)).astype(np.int64))


def _bins(codes: np.ndarray, m: int) -> np.ndarray:
    h = mix64(np.unique(codes)) >> np.uint64(1)
    out = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(out, (h % np.uint64(m)).astype(np.int64), h.view(np.int64))
    return out


def densify(bins: np.ndarray) -> np.ndarray:
    """Each empty bin copies the first non-empty one on its own probe sequence, which all sequences share."""
    out, m = bins.copy(), len(bins)
    empty = bins == np.iinfo(np.int64).max
    if empty.all():
        return out
    open_bins, t = np.flatnonzero(empty), 1
    while len(open_bins):
        probe = (mix64(open_bins.astype(np.uint64) * np.uint64(0x10001) + np.uint64(t)) % np.uint64(m)).astype(np.int64)
        hit = ~empty[probe]
        out[open_bins[hit]] = bins[probe[hit]]
        open_bins, t = open_bins[~hit], t + 1
    return out


def densify_reverse(bins: np.ndarray) -> np.ndarray:
    """Non-empty bins offer copies to the bins on their own sequences, round by round, until none is empty."""
    out, m = bins.copy(), len(bins)
    empty = bins == np.iinfo(np.int64).max
    if empty.all():
        return out
    full, t = np.flatnonzero(~empty), 1
    left = int(empty.sum())
    while left:
        to = (mix64(full.astype(np.uint64) * np.uint64(0x20003) + np.uint64(t)) % np.uint64(m)).astype(np.int64)
        for src, dst in zip(full[empty[to]], to[empty[to]], strict=True):
            if empty[dst]:
                out[dst], empty[dst] = bins[src], False
                left -= 1
        t += 1
    return out


def _set_levels(height: np.ndarray) -> np.ndarray:
    x = -np.log((height.astype(float) + 0.5) / float(1 << 53)) / SET_A
    return np.clip(np.floor(1 - np.log(x) / np.log(SET_B)), 0, SET_Q + 1).astype(np.int64)


def set_kernel(codes: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers: the largest level 1 - log_b(x) over elements, x exponential at rate a.

    The level grows with the hash, so that only the largest hash of each slot is turned into one.
    """
    return set_batch(codes, np.zeros(len(codes), np.int64), 1, m)[0]


def set_batch(codes: np.ndarray, owner: np.ndarray, n: int, m: int, bits: int = 64) -> np.ndarray:
    """``set_kernel`` of each of ``n`` owners, who come in order; a code that several have is hashed once, slot by slot."""
    codes, owner, _ = multiplicities(codes, owner, bits)
    out = np.zeros((n, m), np.int64)
    if not len(codes):
        return out
    distinct, nth = np.unique(codes, return_inverse=True)
    own, slots = mix64(distinct), mix64(np.arange(m).astype(np.uint64) + np.uint64(7))
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for j in range(m):
        height = mix64(own ^ slots[j]) >> np.uint64(11)
        out[owner[first], j] = _set_levels(np.maximum.reduceat(height[nth], first))
    return out


def set_cardinality(registers: np.ndarray) -> float:
    """SetSketch's estimate of the number of distinct elements."""
    return float(len(registers) * (1 - 1 / SET_B) / (SET_A * np.log(SET_B) * np.sum(SET_B ** -registers.astype(float))))


#: Algorithm: kernel, type of a slot, how signatures of parts merge (None: they don't).
KERNELS: dict[str, tuple[Callable, str, str | None]] = {
    "PROB3A": (prob_kernel, "long", None),
    "PROB3": (prob_kernel, "long", None),
    "SUPER": (super_kernel, "double", "min"),
    "SUPER2": (super2_kernel, "long", "min"),
    "OPTDENS": (lambda c, m: densify(_bins(c, m)), "long", None),
    "REVOPTDENS": (lambda c, m: densify_reverse(_bins(c, m)), "long", None),
    "BINS": (_bins, "long", "min"),
    "HLL": (set_kernel, "long", "max"),
}


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def sketch(seqs: DataFrame, params: SketchParams, canonical: bool | None = None) -> DataFrame:
    """(seq_id, sig array): a signature for each sequence that has a k-mer."""
    kernel, slot, _ = KERNELS[params.algo]
    aa = params.data_type == "AA"
    if params.kmer_size > (12 if aa else 32) or params.kmer_size < 1:
        raise ValueError("k is too large for the alphabet")
    both = (not aa) if canonical is None else canonical
    k, m = params.kmer_size, params.sketch_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                codes, owner, _ = batch_codes([s or "" for s in part.column(1).to_pylist()], k, aa, both)
                some, nth = np.unique(owner, return_inverse=True)
                if len(some):
                    if kernel is prob_kernel:
                        sigs = prob_batch(codes, nth, len(some), m, k * (5 if aa else 2))
                    elif kernel is set_kernel:
                        sigs = set_batch(codes, nth, len(some), m, k * (5 if aa else 2))
                    else:
                        sigs = np.stack([kernel(c, m) for c in np.split(codes, np.flatnonzero(np.diff(nth)) + 1)])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), _lists(sigs)], names=["seq_id", "sig"])

    kind = seqs.schema["seq_id"].dataType.simpleString()
    return spread(seqs.select("seq_id", "seq")).mapInArrow(run, f"seq_id {kind}, sig array<{slot}>")


def sketch_all(seqs: DataFrame, params: SketchParams) -> DataFrame:
    """(slot, value): one signature for all sequences together.

    Mergeable kernels give partial signatures that are combined by slot; densification comes after the
    merge of the bins; weighted signatures take the earliest points of the summed weights, part by part.
    The result is the signature that ``sketch`` gives for one sequence with all the k-mers.
    """
    algo, aa = params.algo, params.data_type == "AA"
    if algo in ("PROB3A", "PROB3"):
        total = kmers(seqs, params.kmer_size, not aa).groupBy("kmer").agg(F.count("*").alias("weight"))
        return first_points_of(total, params.kmer_size, params.sketch_size, aa)
    part = SketchParams(params.kmer_size, params.sketch_size, "BINS" if algo.endswith("OPTDENS") else algo, params.data_type)
    merged = merge(sketch(seqs, part), KERNELS[part.algo][2])
    if not algo.endswith("OPTDENS"):
        return merged
    fill = densify if algo == "OPTDENS" else densify_reverse

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("slot")
        return pd.DataFrame({"slot": pdf["slot"], "value": fill(pdf["value"].to_numpy(np.int64))})

    return merged.groupBy(F.lit(0).alias("_")).applyInPandas(lambda pdf: run(pdf), "slot int, value long")  # sketch_size rows


def first_points_of(weights: DataFrame, k: int, m: int, aa: bool = False) -> DataFrame:
    """(slot, value): ProbMinHash of a table of distinct k-mers with weights; ``m`` rows of each partition are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, out = np.full(m, np.inf), np.zeros(m, np.uint64)
        for b in batches:
            time, code = first_points(word_codes(b.column(0).to_pylist(), k, aa), b.column(1).to_numpy(), m)
            out = np.where(time < best, code, out)
            best = np.minimum(time, best)
        some = np.flatnonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(best[some]), pa.array(out.view(np.int64)[some])], names=["slot", "time", "code"])

    points = weights.select("kmer", "weight").mapInArrow(run, "slot int, time double, code long")
    return points.groupBy("slot").agg(F.min_by("code", F.struct("time", "code")).alias("value"))


def merge(sigs: DataFrame, how: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slot, value): union of mergeable signatures, the least or largest value of each slot."""
    agg = {"min": F.min, "max": F.max}[how]
    return sigs.select(*keys, F.posexplode("sig").alias("slot", "v")).groupBy(*keys, "slot").agg(agg("v").alias("value"))


def block_sketch(seqs: DataFrame, k: int, m: int, block: int) -> DataFrame:
    """(seq_id, block_no, sig): a ProbMinHash signature for each block of k-mer starts, numbered within its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 64):
                part = b.slice(start, 64)
                texts = [s or "" for s in part.column(1).to_pylist()]
                codes, owner, place = batch_codes(texts, k, False, True)
                n = np.array([-(-len(s) // block) for s in texts], np.int64)
                which = (n.cumsum() - n)[owner] + place // block
                rows, number = np.repeat(np.arange(len(part)), n), np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
                for at in range(0, len(rows), 1024):
                    lo, hi = np.searchsorted(which, [at, at + 1024])
                    sigs = prob_batch(codes[lo:hi], which[lo:hi] - at, min(1024, len(rows) - at), m, 2 * k)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[at : at + 1024])), pa.array(number[at : at + 1024].astype(np.int32)), _lists(sigs)], names=["seq_id", "block_no", "sig"])

    kind = seqs.schema["seq_id"].dataType.simpleString()
    return spread(seqs.select("seq_id", "seq")).mapInArrow(run, f"seq_id {kind}, block_no int, sig array<long>")


def block_race(seqs: DataFrame, k: int, m: int, block: int) -> DataFrame:
    """(seq_id, block_no, sig): the exponential race (see ``race``) in each block that has a k-mer; blocks of one id and number are one."""

    def make(codes, owner, place, length):
        wide = int(place.max()) // block + 1
        which, nth = np.unique(owner * wide + place // block, return_inverse=True)
        order = np.argsort(nth, kind="stable")
        out = _winners(*multiplicities(codes[order], nth[order], 2 * k), m, k)
        return which // wide, (which % wide).astype(np.int32), _lists(out)

    if k > 31:
        raise ValueError("k must be at most 31")
    return _per_id(seqs, k, False, True, make, "block_no int, sig array<long>")


def race_sketch(seqs: DataFrame, k: int, m: int) -> DataFrame:
    """(seq_id, sig): the exponential race (see ``race``) among the canonical k-mers of each sequence that has one; sequences of one id are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b.slice(at, TOGETHER)
                code, owner, weight = weighted(part.column(1).to_pylist(), k)
                if len(code):
                    some, nth = np.unique(owner, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), _lists(_winners(code, nth, weight, m, k))], names=["seq_id", "sig"])

    if k > 31:
        raise ValueError("k must be at most 31")
    kind = seqs.schema["seq_id"].dataType.simpleString()
    return together(seqs).mapInArrow(run, f"seq_id {kind}, sig array<long>")
