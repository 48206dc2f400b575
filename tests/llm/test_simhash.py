import re

import numpy as np
import xxhash

from strandwise.llm import simhash
from strandwise.llm.components import connected_components


def brute_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, limit=3):
    """Smallest index of each component."""
    f = np.array(prints, np.uint64)
    lab = list(range(len(f)))

    def find(x):
        while lab[x] != x:
            lab[x] = lab[lab[x]]
            x = lab[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= limit):
            a, b = find(i), find(int(j))
            lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_against_brute_force(docs, rows):
    got = {}
    for r in simhash.simhash_components(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    prints = [brute_print(t) for _, t, *_ in rows]
    comp = brute_components(prints)
    for k, (i, *_) in enumerate(rows):
        reach = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None]
        assert (f"{prints[k]:016x}", min(reach, default=None)) in got[i]


def test_ring_finds_every_link_in_dense_neighbourhoods(spark):
    rnd = np.random.default_rng(3)
    centre = rnd.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rnd.choice(64, rnd.integers(0, 6), replace=False).astype(np.uint64)) for _ in range(600)]
    prints = np.unique(np.array([centre[k % 6] ^ f for k, f in enumerate(flips)], np.uint64))
    df = spark.createDataFrame([(int(p.view(np.int64)), k) for k, p in enumerate(prints)], "fp long, rep long")
    want = brute_components(prints)
    for block in (16, 4096):
        found = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, 3, block)).collect()}
        assert [found.get(k, k) for k in range(len(prints))] == want


def test_one_row_of_each_component_stays(docs, rows, empty, spark):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    comp = brute_components([brute_print(t) for _, t, *_ in rows])
    want = []
    for c in set(comp):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == c and rows[j][0] is not None]
        want.append(min(ids) if ids else -1)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)
    same = spark.createDataFrame([(1, "a b c d")] * 3 + [(None, "e f g h")] * 3 + [(None, "i j k l"), (2, "i j k l")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) + r["text"] for r in simhash.one_of_each(same).collect()) == ["1a b c d", "2i j k l", "Nonee f g h"]
    assert simhash.one_of_each(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(600, 700)] + [(7, 7)]
    df = spark.createDataFrame([*edges, *edges[:9]], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert {got[k] for k in range(101, 161)} == {100} and {got[k] for k in range(600, 700)} == {500} and 7 not in got
    assert connected_components(df.limit(0)).count() == 0


def test_components_of_random_graphs_with_hubs(spark):
    rnd = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 3000, (1200, 2))] + [(2999, int(b)) for b in rnd.integers(0, 3000, 900)] + [(-5, 17), (17, -9)]
    lab = {}

    def find(x):
        while lab.setdefault(x, x) != x:
            x = lab[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        lab[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in lab if find(x) != x}
