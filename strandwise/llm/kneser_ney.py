"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by workers.

The model is of order two.  Training runs in three passes whose intermediate data are packed arrays:

1. Words are counted by their 64-bit hash; each shard of the hash range becomes a sorted array of hashes
   with counts.  A word's place in the arrays is its number.
2. Pairs (context number, word number) are counted in buckets of about ``FILE`` tokens: ranges of contexts,
   whose tokens are known from the first pass, while a context with more tokens than that is split by
   its words.  Each bucket becomes a sorted array of pair keys, those seen once apart from those with a count, beside
   each context's total and its numbers of words seen once, twice and more often (for a split context these are
   summed over its buckets).  Each bucket also counts in how many contexts it saw each word.
3. Those continuation counts are summed by ranges of words, as many as there are buckets, and joined by shard.

So no task holds more than about ``FILE`` tokens' pairs, however frequent a word is.  All counts are 64-bit.

The arrays are files in the shared folder.  Scoring workers map them (from a private copy where the
folder isn't local; at most ``OPEN`` maps at once), look up sorted keys shard by shard, and add up log10 probabilities
by document:

    p(w|u) = (c(uw) - D) / c(u) + gamma(u) * q(w),    q(w) = (N(.w) - d) / N(..) + gamma * 1 / (V + 1)

with the modified discounts D1, D2, D3+ from counts of counts on each level; q alone for unseen contexts.
An unknown word has only the uniform share.  Nothing is cut off: pairs seen once stay in the model.

A text's tokens are its words, A-Z in lower case, and one end; texts are read whole.  Null texts are empty: only an
end.  Rows with null ids are in the training fold and scored like any other.  Repeated rows count as often as they
occur.  Without training rows every token has probability one, as the uniform share over V + 1 = 1
outcomes.  An empty table gives an empty result.  Columns other than id and text are never read, so their
names can't clash.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, fresh_path

SEED = 7
#: Rows handled at once, words remembered before a flush, pairs gathered before a flush.
ROWS, WORDS, PAIRS = 400, 200_000, 2_000_000
#: Entries aimed at in one file, and files mapped at once by a worker (each holds a handle).
FILE, OPEN = 2_000_000, 256
END, BEGIN = b" ", b"  "  # no word has a space
ONE = 1 << 32


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, SEED)


class Store:
    """Arrays as files below a folder that all machines see."""

    def __init__(self, uri: str):
        self.uri = uri
        self.mapped: OrderedDict[str, np.ndarray] = OrderedDict()

    def _at(self, name: str):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(f"{self.uri}/{name}")
        return where, path

    def put(self, name: str, a: np.ndarray) -> None:
        """Written under another name first, so a repeated task leaves one whole file."""
        where, path = self._at(name)
        where.create_dir(os.path.dirname(path), recursive=True)
        with where.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(np.ascontiguousarray(a).data)
        where.move(part, path)

    def get(self, name: str, dtype) -> np.ndarray:
        if name not in self.mapped:
            from pyarrow import fs

            where, path = self._at(name)
            if not isinstance(where, fs.LocalFileSystem):
                with where.open_input_stream(path) as src, tempfile.NamedTemporaryFile(delete=False) as own:
                    while block := src.read(1 << 22):
                        own.write(block)
                path = own.name
            self.mapped[name] = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
            if not isinstance(where, fs.LocalFileSystem):
                os.unlink(path)  # the mapping keeps it until the worker ends
            while len(self.mapped) > OPEN:
                self.mapped.popitem(last=False)
        self.mapped.move_to_end(name)
        return self.mapped[name]


def _pack(a: np.ndarray) -> bytes:
    """Sorted or small integers by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=a.dtype.type(0)))


def _unpack_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(_unpack(b, dtype), dtype=dtype)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """A few rows at a time: the first row's number and the words of each row."""
    texts = batch.column(column).cast(pa.binary())
    for k in range(0, len(texts), ROWS):
        yield k, [(t or b"").lower().split() for t in texts.slice(k, ROWS).to_pylist()]


class Model:
    """The mapped arrays, and lookups that visit each file once for sorted keys."""

    def __init__(self, uri: str, meta: dict):
        self.store, self.meta = Store(uri), meta
        self.starts = np.array([*meta["shard_starts"], meta["V"]], np.int64)
        self.bits = meta["bits"]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edge = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        for s in range(1 << self.bits):
            a, b = edge[s], edge[s + 1]
            if a < b and self.starts[s + 1] > self.starts[s]:
                known = self.store.get(f"words/{s}.hash", np.uint64)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self.starts[s], -1)
        return out

    def by_word(self, kind: str, ids: np.ndarray, dtype) -> np.ndarray:
        """Values of sorted word numbers, 0 for unknown ones."""
        out = np.zeros(len(ids), dtype)
        edge = np.searchsorted(ids, self.starts)
        for s in range(1 << self.bits):
            a, b = edge[s], edge[s + 1]
            if a < b:
                out[a:b] = self.store.get(f"words/{s}.{kind}", dtype)[ids[a:b] - self.starts[s]]
        return out

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted pair keys, and the row of (total, once, twice, more) of each key's context."""
        count, context = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        edges = np.array(self.meta["edges"], np.uint64)
        where = np.append(np.searchsorted(keys, edges), len(keys))
        for k in np.flatnonzero(where[:-1] < where[1:]):
            a, b = where[k], where[k + 1]
            q = keys[a:b]
            once = self.store.get(f"pairs/{k}.once", np.uint64)
            often = self.store.get(f"pairs/{k}.often", np.uint64)
            got = np.zeros(b - a, np.int64)
            if len(once):
                at = np.minimum(np.searchsorted(once, q), len(once) - 1)
                got[once[at] == q] = 1
            if len(often):
                at = np.minimum(np.searchsorted(often, q), len(often) - 1)
                hit = often[at] == q
                got[hit] = self.store.get(f"pairs/{k}.count", np.int64)[at[hit]]
            count[a:b] = got
            first = int(edges[k] >> np.uint64(32))
            if (split := self.meta["split"].get(first)) is not None:
                context[a:b] = split
            else:
                context[a:b] = self.store.get(f"pairs/{k}.context", np.int64).reshape(-1, 4)[(q >> np.uint64(32)).astype(np.int64) - first]
        return count, context


def bucket_edges(counts: np.ndarray, first: int, width: int, file: int) -> list[int]:
    """First pair key of each bucket for contexts ``first``, ``first`` + 1, ... that hold ``counts`` tokens.

    A context with more than ``file`` tokens has buckets of its own, equal ranges of the ``width`` word numbers;
    others share a bucket up to about ``file`` tokens.
    """
    big = np.flatnonzero(counts > file)
    small = np.where(counts > file, 0, counts)
    turn = np.cumsum(small) // file
    opens = np.flatnonzero(np.diff(turn, prepend=-1))  # the first context of each range of tokens
    opens = np.union1d(opens, np.union1d(big, np.minimum(big + 1, len(counts) - 1))) if len(counts) else opens
    edges = []
    for u in opens.tolist():
        parts = -(-int(counts[u]) // file) if counts[u] > file else 1
        edges += [((first + u) << 32) | (width * k // parts) for k in range(parts)]
    return edges


def discounts(t: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and more, from how many n-grams have counts 1 to 4."""
    t1, t2, t3, t4 = (float(x) for x in t)
    if not t1 or not t2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = t1 / (t1 + 2 * t2)
    d = [1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3 if t3 else 3.0]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, text_col: str = "text") -> tuple[str, dict]:
    """Build the model of all texts of ``docs``; its folder and a small description."""
    spark = docs.sparkSession
    uri = fresh_path(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush():
            h = np.array([_hash(w) for w in seen], np.uint64).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], names=["h", "c"])
            seen.clear()
            return out

        get = seen.get
        for batch in batches:
            for _, rows in slices(batch, 0):
                for row in rows:
                    for w in row:
                        seen[w] = get(w, 0) + 1
                seen[END] = get(END, 0) + len(rows)
                if len(seen) >= WORDS:
                    yield flush()
        if seen:
            yield flush()

    counted = cut(texts.mapInArrow(words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    v, n = counted.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    if v >= ONE - 1:
        raise ValueError("more distinct words than 32-bit numbers")
    bits = max(0, int(np.ceil(np.log2(max(1, v) / FILE)))) if v else 0
    bits = max(bits, 4)
    shard = F.shiftrightunsigned("h", 64 - bits)

    file = min(FILE, max(1, n // 16))  # some parallelism for small corpora

    def write_words(key, pdf):
        import pandas as pd

        h = pdf["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        counts = pdf["c"].to_numpy(np.int64)[order]
        store = Store(uri)
        store.put(f"words/{key[0]}.hash", h[order])
        store.put(f"words/{key[0]}.count", counts)
        return pd.DataFrame({"shard": [key[0]], "n": [len(h)], "edges": [bucket_edges(counts, 0, v, file)]})

    # About one edge for each FILE tokens.
    shards = {r["shard"]: r for r in counted.withColumn("shard", shard).groupBy("shard").applyInPandas(write_words, "shard long, n long, edges array<long>").collect()}
    starts = np.cumsum([0, *[shards[k]["n"] if k in shards else 0 for k in range(1 << bits)]]).tolist()
    edges = [e + (starts[k] << 32) for k in range(1 << bits) if k in shards for e in shards[k]["edges"]]
    texts_begun = counted.filter(F.col("h") == F.lit(int(np.array(_hash(END), np.uint64).view(np.int64)))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    edges += bucket_edges(np.array([texts_begun], np.int64), v, v, file)  # the context before a text's first word
    seen, split = set(), []
    for e in edges:
        if (u := e >> 32) in seen:
            split.append(u)
        seen.add(u)
    buckets = len(edges)
    meta = {"V": v, "N": n, "bits": bits, "buckets": buckets, "edges": edges, "shard_starts": starts[:-1]}
    divided = frozenset(split)
    within = max(1, buckets >> bits)  # ranges of words by which each shard's continuation counts are summed
    ranges = [starts[s] + (starts[s + 1] - starts[s]) * k // within for s in range(1 << bits) for k in range(within)] + [v]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(uri, meta)
        first_keys = np.array(edges, np.uint64)
        held: list[np.ndarray] = []
        total = 0

        def flush():
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            at = np.append(np.searchsorted(keys, first_keys), len(keys))
            held.clear()
            some = [k for k in range(buckets) if at[k] < at[k + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([_pack_sorted(keys[at[k] : at[k + 1]]) for k in some], pa.binary()), pa.array([_pack(c[at[k] : at[k + 1]].astype(np.uint32)) for k in some], pa.binary())],
                names=["bucket", "keys", "counts"],
            )

        for batch in batches:
            for _, rows in slices(batch, 0):
                ids, begin = token_ids(model, rows)
                held.append(context_ids(ids, begin, v) << np.uint64(32) | ids.astype(np.uint64))
                total += len(ids)
                if total >= PAIRS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    def write_pairs(key, pdf):  # one bucket
        import pandas as pd

        k = int(key[0])
        keys = np.concatenate([_unpack_sorted(b, np.uint64) for b in pdf["keys"]])
        c = np.concatenate([_unpack(b, np.uint32) for b in pdf["counts"]])
        del pdf
        order = np.argsort(keys, kind="stable")
        keys, c = keys[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, c = keys[first], np.add.reduceat(c.astype(np.int64), first)
        first = edges[k] >> 32
        u = (keys >> np.uint64(32)).astype(np.int64) - first
        context = np.stack([np.bincount(u, w) for w in (c, c == 1, c == 2, c > 2)], 1).astype(np.int64)
        store = Store(uri)
        store.put(f"pairs/{k}.once", keys[c == 1])
        store.put(f"pairs/{k}.often", keys[c > 1])
        store.put(f"pairs/{k}.count", c[c > 1])
        store.put(f"pairs/{k}.context", np.concatenate([context, np.zeros((max(0, width[k] - len(context)), 4), np.int64)]))
        w, seen = np.unique(keys & np.uint64(ONE - 1), return_counts=True)
        at = np.searchsorted(w, np.array(ranges, np.uint64))
        some = [s for s in range(len(ranges) - 1) if at[s] < at[s + 1]]
        own = [first, *context[0].tolist()] if first in divided else []
        return pd.DataFrame(
            {"part": [-1, *some], "w": [b"", *[_pack_sorted(w[at[s] : at[s + 1]]) for s in some]], "n": [b"", *[_pack(seen[at[s] : at[s + 1]].astype(np.uint32)) for s in some]], "t": [[*_counts_of_counts(c), *own], *[[]] * len(some)]}
        )

    packed = texts.mapInArrow(pairs, "bucket int, keys binary, counts binary")
    # Contexts from each bucket's first to the next bucket's, whether or not they were met as contexts.
    width = [max(1, min((edges[k + 1] >> 32) if k + 1 < buckets else v + 1, v + 1) - (edges[k] >> 32)) for k in range(buckets)]
    done = cut(packed.groupBy("bucket").applyInPandas(write_pairs, "part int, w binary, n binary, t array<long>"), "pairs")
    own = done.filter("part = -1")
    t = own.agg(*[F.coalesce(F.sum(F.col("t")[k]), F.lit(0)) for k in range(4)]).first()
    shared = own.filter(F.size("t") > 4).groupBy(F.col("t")[4].alias("u")).agg(*[F.sum(F.col("t")[k]).alias(f"x{k}") for k in range(5, 9)])
    meta["split"] = {r["u"]: [r["x5"], r["x6"], r["x7"], r["x8"]] for r in shared.collect()}  # contexts of over FILE tokens

    def sum_part(key, pdf):
        import pandas as pd

        k = int(key[0])
        total = np.zeros(ranges[k + 1] - ranges[k], np.int64)
        for w, n in zip(pdf["w"], pdf["n"], strict=True):
            total[(_unpack_sorted(w, np.uint64) - np.uint64(ranges[k])).astype(np.int64)] += _unpack(n, np.uint32)
        return pd.DataFrame({"shard": [k // within], "part": [k], "n": [_pack(total.astype(np.uint32))], "t": [_counts_of_counts(total)], "all": [int(total.sum())], "many": [int((total > 2).sum())]})

    summed = cut(done.filter("part >= 0").groupBy("part").applyInPandas(sum_part, "shard int, part int, n binary, t array<long>, all long, many long"), "continuations")
    last = summed.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (*[F.col("t")[k] for k in range(4)], "all", "many")]).first()

    def write_continuations(key, pdf):
        import pandas as pd

        s = int(key[0])
        total = np.zeros(starts[s + 1] - starts[s], np.uint32)
        for k, n in zip(pdf["part"], pdf["n"], strict=True):
            total[ranges[k] - starts[s] : ranges[k + 1] - starts[s]] = _unpack(n, np.uint32)
        Store(uri).put(f"words/{s}.contexts", total)  # at most V + 1 contexts, so 32 bits do
        return pd.DataFrame({"shard": [s]})

    written = {r["shard"] for r in summed.groupBy("shard").applyInPandas(write_continuations, "shard int").collect()}
    assert all(k in written for k in shards)
    meta |= {"pair_counts": list(t), "context_counts": list(last[:4]), "pairs": last[4], "many": last[5]}
    return uri, meta


def token_ids(model: Model, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all tokens of some rows in order, each row with its end, and where each row begins."""
    index: dict[bytes, int] = {END: 0}
    put = index.setdefault
    local: list[int] = []
    for row in rows:
        local.extend([put(w, len(index)) for w in row])
        local.append(0)
    h = np.array([_hash(w) for w in index], np.uint64)
    order = np.argsort(h)
    ids = np.empty(len(h), np.int64)
    ids[order] = model.word_ids(h[order])
    begin = np.cumsum([0, *[len(r) + 1 for r in rows]])[:-1]
    return ids[np.array(local, np.int64)], begin


def context_ids(ids: np.ndarray, begin: np.ndarray, v: int) -> np.ndarray:
    out = np.empty(len(ids), np.uint64)
    out[1:] = ids[:-1].astype(np.uint64)
    out[begin] = v
    return out


def log_probabilities(model: Model, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count in training, base log10, model log10) of each token."""
    m = model.meta
    v, n = m["V"], m["N"]
    uniq, inverse = np.unique(ids, return_inverse=True)
    count = model.by_word("count", uniq, np.int64)
    count[uniq < 0] = 0
    base = np.log10((count + 1.0) / (n + v + 1.0))
    if not n:
        return count[inverse].astype(np.int64), base[inverse], np.zeros(len(ids))
    seen = model.by_word("contexts", uniq, np.uint32).astype(np.int64)
    seen[uniq < 0] = 0
    d1 = discounts(m["context_counts"])
    t1, t2 = m["context_counts"][:2]
    spare = (d1[1] * t1 + d1[2] * t2 + d1[3] * m["many"]) / m["pairs"]
    q = ((seen - d1[np.minimum(seen, 3)]) / m["pairs"] + spare / (v + 1.0))[inverse]
    prev = context_ids(ids, begin, v).astype(np.int64)
    known = prev >= 0
    keys = prev[known].astype(np.uint64) << np.uint64(32) | np.where(ids[known] >= 0, ids[known], ONE - 1).astype(np.uint64)
    order = np.argsort(keys)
    c, context = np.empty(len(keys), np.int64), np.empty((len(keys), 4), np.int64)
    c[order], context[order] = model.pairs(keys[order])
    d2 = discounts(m["pair_counts"])
    p = q.copy()
    total = np.maximum(context[:, 0], 1)
    mixed = (c - d2[np.minimum(c, 3)]) / total + context[:, 1:] @ d2[1:] / total * q[known]
    p[known] = np.where(context[:, 0] > 0, mixed, q[known])
    return count[inverse].astype(np.int64), base[inverse], np.log10(p)


def score_documents(docs: DataFrame, uri: str, meta: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; one map pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(uri, meta)
        for batch in batches:
            for k, rows in slices(batch, 1):
                ids, begin = token_ids(model, rows)
                count, base, logp = log_probabilities(model, ids, begin)
                add = lambda x: np.add.reduceat(x, begin)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, ROWS), pa.array(np.diff(np.append(begin, len(ids)))), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(rows), meta["N"], np.int64)), pa.array(add(base)), pa.array(add(logp))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of all rows by a model of the rows outside the held-out fold."""
    uri, meta = train(docs.filter(crc_mod(id_col, folds) != held).select(text_col), text_col)
    return score_documents(docs, uri, meta, id_col, text_col)
