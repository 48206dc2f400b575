"""Embedding near-duplicates by an exact metric range join.

On the unit sphere cosine >= c means Euclidean distance <= r = sqrt(2 - 2c).  Pivots partition the vectors:
each has its home in the cell of its nearest pivot.  By the triangle inequality a vector x can be within r
of a home vector of cell j only if it lies within r of the boundary towards j, that is if
(cos(x, own pivot) - cos(x, pivot j)) <= r * |own pivot - pivot j|.  Of two cells the lower-numbered one joins
the pairs that cross between them, so x visits only such cells j below its own; every pair is then compared
once, in one cell, and cells join independently.  Within a cell the pivot distances prune once more:
partners differ in theirs by at most r.

Equal vectors are compared once and count with their number.  A cell's homes and visitors are dealt in
blocks of about ``block`` vectors and joined by pairs of blocks, so no task holds an unbounded cell; a
task returns counts and a spanning forest of its links, never the links themselves.  A block pair is first
multiplied in single precision; pairs within its rounding error of the bound are judged in double.

Links and components are found between groups of equal vectors, which are numbered when they are written;
a component's id is the least vec_id of its rows, whatever their signs.  Rows with null ids are ends of links
like any other and take their component's least id; a component of null ids alone has a null id and all its
rows are kept.  Rows that repeat an id are separate vectors.

Null vectors, zero vectors, and those with null or non-finite components link with nothing: they are their
own component.  Vectors of different lengths never link.  Vectors of any length are taken whole.  An empty table
gives an empty result.  Columns other than id and vector are never read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_join
from .components import connected_components
from .simhash import forest

SLICE = 512  # rows of a block that are multiplied at once
#: Added to the pivot bounds, which are rounded; links themselves are judged by their cosine alone.
SLACK = 1e-9


def _unit(values: list) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots among sampled unit vectors."""
    at = [0]
    near = sample @ sample[0]
    while len(at) < min(n, len(sample)):
        at.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[at[-1]])
    return sample[at]


def _near(a: np.ndarray, b: np.ndarray, a32: np.ndarray, b32: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs have at least ``cosine`` in double precision; single precision settles all clear cases."""
    rough = a32 @ b32.T
    error = np.float32((a.shape[1] + 16) * 2.5e-7)
    near = rough >= np.float32(cosine) - error
    if near.any():
        i, j = np.nonzero(near & (rough <= np.float32(cosine) + error))
        for k in range(0, len(i), 1 << 18):
            x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            near[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
    return near


def block_join(home: np.ndarray, other: np.ndarray, pivot: np.ndarray, home_weight: np.ndarray, other_weight: np.ndarray, home_rep: np.ndarray, other_rep: np.ndarray, cosine: float):
    """Linked weight for each vector of both sides (unit vectors, no pair compared twice), and a forest of the links."""
    r = np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    far = lambda x: np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivot)))
    dh, dt = far(home), far(other)
    oh, ot = np.argsort(dh, kind="stable"), np.argsort(dt, kind="stable")
    sorted_dt = dt[ot]
    h32, t32 = home.astype(np.float32), other[ot].astype(np.float32)
    links, back = np.zeros(len(home), np.int64), np.zeros(len(other), np.int64)
    edges = []
    for k in range(0, len(oh), SLICE):
        rows = oh[k : k + SLICE]
        a = np.searchsorted(sorted_dt, dh[rows[0]] - r, "left")
        b = np.searchsorted(sorted_dt, dh[rows[-1]] + r, "right")
        cols = ot[a:b]
        if not len(cols):
            continue
        near = _near(home[rows], other[cols], h32[rows], t32[a:b], cosine)
        near &= home_rep[rows][:, None] != other_rep[cols][None, :]
        some = near.any(axis=1)
        if not some.any():
            continue
        rows, near = rows[some], near[some]
        used = near.any(axis=0)
        cols, near = cols[used], near[:, used]
        links[rows] += near @ other_weight[cols]
        back[cols] += home_weight[rows] @ near
        # Components of the bipartite block, by spreading the smallest label until nothing changes.
        hl, tl = home_rep[rows].copy(), other_rep[cols].copy()
        top = np.iinfo(np.int64).max
        while True:
            h2 = np.minimum(hl, np.where(near, tl[None, :], top).min(axis=1))
            t2 = np.minimum(tl, np.where(near, h2[:, None], top).min(axis=0))
            if (h2 == hl).all() and (t2 == tl).all():
                break
            hl, tl = h2, t2
        edges.append(np.stack([np.concatenate([home_rep[rows], other_rep[cols]]), np.concatenate([hl, tl])]))
    if edges:
        e = np.concatenate(edges, axis=1)
        return links, back, forest(e[0], e[1])
    return links, back, (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = 8192, block: int = 8192, sample_rows: int = 4000, max_pivots: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    There are n / ``cell`` pivots, ``max_pivots`` at most: beyond that cells grow, as more blocks.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, v).alias("v"))
    rows = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))  # 128 bits stand for the vector
    same = rows.filter("v IS NOT NULL").groupBy("k1", "k2", F.size("v").alias("dim")).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    # A group's number in comparisons is written with it, so every reader sees the same.
    distinct = cut(same.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    lone = rows.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    dims = [r["dim"] for r in distinct.select("dim").distinct().toLocalIterator()]
    links = components = None
    for dim in dims:  # vectors of different lengths have no cosine
        part = distinct.filter(F.col("dim") == dim)
        n = part.count()
        pivots_wanted = int(min(max_pivots, max(1, -(-n // cell))))
        share = min(1.0, 1.2 * sample_rows / n)
        picked = part.filter(F.shiftrightunsigned(F.xxhash64("k1"), 11) < F.lit(int(share * (1 << 53)))).orderBy("k1", "k2").limit(sample_rows).select("v").collect()
        sample = _unit([r["v"] for r in picked] or [part.orderBy("k1", "k2").select("v").first()["v"]])  # at most sample_rows vectors
        pivots = choose_pivots(sample, pivots_wanted)
        l, c = _cells(spark, part, pivots, cosine, block)
        links = l if links is None else links.union(l)
        components = c if components is None else components.union(c)
    if links is None:
        return lone.withColumn("kept", F.lit(True))
    comps = connected_components(components)
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = distinct.select("k1", "k2", "rep", "least", "weight").join(counted, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    groups = cut(groups.select("k1", "k2", "least", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root")), "groups")
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_members"))
    groups = split_join(groups, named, "root", "_members", distinct.count())
    key = F.struct("k1", "k2")
    ids = rows.filter("v IS NOT NULL").select("vec_id", key.alias("k"))
    joined = split_join(ids, groups.select(key.alias("k"), "n_links", "component_id", "weight"), "k", "weight", ids.count())
    out = joined.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id")).union(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _cells(spark, part: DataFrame, pivots: np.ndarray, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))

    def place(batches):
        import pandas as pd

        for whole in batches:
            for k in range(0, len(whole), 1024):
                pdf = whole.iloc[k : k + 1024]
                x = _unit(pdf["v"].tolist())
                to = x @ pivots.T
                own = to.argmax(axis=1)
                near = to[np.arange(len(x)), own][:, None] - to <= r * gaps[own] + SLACK
                near &= np.arange(len(pivots))[None, :] < own[:, None]
                near[np.arange(len(x)), own] = True
                row, where = np.nonzero(near)
                yield pd.DataFrame({"cell": where.astype(np.int32), "home": own[row] == where, "rep": pdf["rep"].to_numpy()[row], "weight": pdf["weight"].to_numpy()[row], "v": pdf["v"].to_numpy()[row]})

    kind = part.schema["v"].dataType.simpleString()
    placed = cut(part.select("rep", "weight", "v").mapInPandas(place, f"cell int, home boolean, rep long, weight long, v {kind}"), "cells")
    homes = F.sum(F.col("home").cast("int"))
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = placed.groupBy("cell").agg(blocks(homes).alias("h"), blocks(F.count("*") - homes).alias("w"))
    # Blocks of homes are 0 to h - 1, of visitors h to h + w - 1; block i < h meets every block j >= i.
    sized = placed.join(F.broadcast(sizes), "cell")  # one row for each pivot
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("h")).otherwise(F.col("w"))).cast("int")
    sized = sized.filter("h > 0").withColumn("own", F.when(F.col("home"), own).otherwise(own + F.col("h")))
    last = F.when(F.col("home"), F.col("h") + F.col("w")).otherwise(F.col("h")) - 1
    dealt = sized.withColumn("met", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("cell", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "rep", "weight", "v")

    def join(key, pdf):
        import pandas as pd

        first = pdf["own"].to_numpy() == key[1]
        if not first.any() or (key[1] != key[2] and first.all()):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        x, rep, weight = _unit(pdf["v"].tolist()), pdf["rep"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        second = first if key[1] == key[2] else ~first
        found, back, (a, b) = block_join(x[first], x[second], pivots[key[0]], weight[first], weight[second], rep[first], rep[second], cosine)
        counts = np.zeros(len(x), np.int64)
        counts[first] += found
        if key[1] != key[2]:
            counts[second] += back
        some = counts > 0
        return pd.DataFrame({"a": np.concatenate([a, rep[some]]), "b": np.concatenate([b, rep[some]]), "links": np.concatenate([np.zeros(len(a), np.int64), counts[some]])})

    done = cut(dealt.groupBy("cell", "i", "j").applyInPandas(join, "a long, b long, links long"), "pairs")
    return done.filter("links > 0").select(F.col("a").alias("rep"), "links"), done.filter("links = 0").select("a", "b")
