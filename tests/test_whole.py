"""Queries do the whole job: results against brute force over every sequence or pair."""

import time
from collections import Counter

import numpy as np
import pytest

from strandwise.operators import kmers as K
from strandwise.operators import similarity as SI
from strandwise.operators import sketch as SK
from strandwise.plans.queries import QUERIES, SQL, seqs, slot_values


def classes(spark, sf, k):
    """{signature: ids} of all sequences."""
    out = {}
    for r in SK.sketch(seqs(spark, sf), SK.SketchParams(k, 64, "PROB3A")).collect():
        out.setdefault(tuple(r["sig"]), []).append(r["seq_id"])
    return out


def brute(groups, top):
    """{(a, b): sim} of the ``top`` nearest classes of each, on a tie the least id."""
    named = sorted((min(v), k) for k, v in groups.items())
    ids, sig = [x for x, _ in named], np.array([k for _, k in named])
    out = {}
    for i, s in enumerate(sig):
        sim = (sig == s).mean(axis=1)
        sim[i] = 0
        out |= {(ids[i], ids[j]): sim[j] for j in np.argsort(-sim, kind="stable")[:top] if sim[j] > 0}
    return out


@pytest.mark.parametrize("name,k,top", [("ann_build", 12, 10), ("sink_hnsw", 14, 5)])
def test_neighbours_against_brute_force(spark, sf, name, k, top):
    got = {(r["a"], r["b"]): r["sim"] if name == "ann_build" else 1 - r["dist"] for r in QUERIES[name](spark, sf).collect() if r["a"] != r["b"]}
    want = brute(classes(spark, sf, k), top)
    assert len(want) > 500 and len(set(want) & set(got)) >= 0.9 * len(want)
    assert all(got[p] == pytest.approx(want[p]) for p in set(want) & set(got))


@pytest.mark.parametrize("name,k", [("ann_build", 12), ("sink_hnsw", 14)])
def test_every_copy_is_linked_to_its_class(spark, sf, name, k):
    groups = classes(spark, sf, k).values()
    got = QUERIES[name](spark, sf).filter("rank = 0" if name == "ann_build" else "dist = 0").collect()
    assert any(len(v) > 1 for v in groups)
    assert sorted((r["a"], r["b"]) for r in got) == sorted((i, min(v)) for v in groups for i in v)


@pytest.mark.parametrize("values,held", [(3, 1 << 20), (3, 50), (40, 500), (1000, 10)])
def test_blocks_are_compared_once_for_both(monkeypatch, values, held):
    monkeypatch.setattr(SI, "HELD", held)
    rnd = np.random.default_rng(values)
    x, y = (np.minimum(rnd.geometric(2 / values, (n, 12)), values) for n in (400, 300))
    near = (x[:, None] == y[None]).sum(axis=2)
    least = [rnd.integers(1, 5, len(z)) for z in (x, y)]
    for found, equal, at_least in zip(SI._nearest_across(x, y, *least, 6), (near, near.T), least, strict=True):
        want = [(i, j, row[j]) for i, row in enumerate(equal) for j in np.argsort(-row, kind="stable")[:6] if row[j] >= at_least[i]]
        assert list(zip(*(z.tolist() for z in found), strict=True)) == want and len(want) > 100


@pytest.mark.parametrize("values,n", [(4, 700), (300, 700), (300, 3)])
def test_neighbours_are_exact_with_ties(spark, values, n):
    rnd = np.random.default_rng(values)
    sigs = np.minimum(rnd.geometric(2 / values, (n, 10)), values) + (0 if values == 4 else 1 << 40)
    groups = {}
    for i, s in enumerate(sigs.tolist()):
        groups.setdefault(tuple(s), []).append(i)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sigs.tolist())], "seq_id long, sig array<long>")
    got = SI.nearest(df, 5, blocks=8).collect()
    assert {(r["a"], r["b"]): r["sim"] for r in got} == brute(groups, 5)
    assert all(r["rank"] == 1 + sum((-o["sim"], o["b"]) < (-r["sim"], r["b"]) for o in got if o["a"] == r["a"]) for r in got[:50])


def rc(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_counts_cover_every_sequence(spark, sf):
    texts = [r["seq"] or "" for r in seqs(spark, sf).collect()]
    count = Counter(min(w, rc(w)) for t in texts for w in (t[i : i + 11] for i in range(len(t) - 10)))
    got = {r["kmer"]: r["cnt"] for r in QUERIES["cnt_get"](spark, sf).collect()}
    assert {min(t[:11], rc(t[:11])) for t in texts if len(t) >= 11} <= set(got) and 0 in got.values()
    assert got == {k: count[k] for k in got}


def test_every_base_is_iterated(spark, sf):
    want = {(r["seq_id"], i, c, r["seq"][-1 - i]) for r in seqs(spark, sf).collect() for i, c in enumerate(r["seq"] or "")}
    got = [tuple(r) for r in QUERIES["seq_iter"](spark, sf).select("seq_id", "pos", "base", "back").collect()]
    assert len(got) == len(want) and set(got) == want


def test_bases_of_chunks(spark):
    texts = ["ACGGT" * 40_000 + "T", "ACGT" * (K.CHUNK // 4), "", "G"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    rows = K.bases(df).orderBy("seq_id", "pos").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r["seq_id"] == i]
        assert [r["pos"] for r in own] == list(range(len(t)))
        assert "".join(r["base"] for r in own) == t and "".join(r["back"] for r in own) == t[::-1]


def test_pairs_do_not_depend_on_the_order_of_ids(spark):
    sigs = {2: [1, 2, 3, 4], 9: [1, 2, 3, 4], 5: [1, 2, 7, 8], 40: [0, 2, 7, 7], 77: [9, 9, 9, 9]}
    df = spark.createDataFrame(list(sigs.items()), "seq_id long, sig array<long>")
    got = {tuple(r) for r in SI.slot_agreements(df).select("a", "b", "slot", "value").collect()}
    assert got == {(a, b, s, x) for a, b in [(2, 5), (2, 40), (5, 40), (2, 9)] for s, (x, y) in enumerate(zip(sigs[a], sigs[b], strict=True)) if x == y}


def counted(rows, m, apart=lambda key: key):
    """{key: (class, numbers of others with 1, 2, ... equal slots)} by brute force over {key: signature}."""
    keys, every = sorted(rows), np.array([rows[k] for k in sorted(rows)])
    out = {}
    for k in keys:
        equal = (every == rows[k]).sum(axis=1)
        other = np.array([apart(x) != apart(k) for x in keys])
        out[k] = (next(x for x, e in zip(keys, equal, strict=True) if e == m), tuple(np.bincount(equal[other], minlength=m + 1)[1:].tolist()))
    return out


def test_links_count_copies_and_all_members_of_classes(spark):
    sigs = {2: [1, 2, 3, 4], 9: [1, 2, 3, 4], 5: [1, 2, 7, 8], 6: [1, 2, 7, 8], 40: [0, 2, 7, 7], 77: [9, 9, 9, 9]}
    df = spark.createDataFrame(list(sigs.items()), "seq_id long, sig array<long>")
    got = {r["seq_id"]: (r["class"], tuple(r[f"n_{j}"] for j in range(1, 5))) for r in SI.link_counts(df, 4).collect()}
    assert got == counted(sigs, 4)
    assert got[9] == (2, (1, 2, 0, 1)) and got[77] == (77, (0, 0, 0, 0))


def test_links_of_large_groups_and_of_one_sequence(spark):
    rnd = np.random.default_rng(3)
    sigs = {(int(i) // 9, int(i) % 9): rnd.integers(0, 3, 5).tolist() for i in range(1500)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in sigs.items()], "seq_id long, block_no int, sig array<long>")
    for apart in (None, "seq_id"):
        rows = SI.link_counts(df, 5, ("seq_id", "block_no"), apart).collect()
        got = {(r[0], r[1]): ((r[2], r[3]), tuple(r[f"n_{j}"] for j in range(1, 6))) for r in rows}
        assert got == counted(sigs, 5, (lambda k: k[0]) if apart else (lambda k: k))


@pytest.mark.parametrize("null", [False, True])
def test_links_by_a_table_of_frequent_values(spark, monkeypatch, null):
    monkeypatch.setattr(SI, "DIRECT", 100)
    rnd = np.random.default_rng(4)
    sigs = {(int(i) // 9, int(i) % 9): np.minimum(rnd.geometric(0.3, 5), 30).tolist() for i in range(1500)}
    df = spark.createDataFrame([(None if null and a == 7 else a, b, s) for (a, b), s in sigs.items()], "seq_id long, block_no int, sig array<long>")
    for apart in (None, "seq_id"):
        rows = SI.link_counts(df, 5, ("seq_id", "block_no"), apart).collect()
        got = {(7 if r[0] is None else r[0], r[1]): (r["n_links"], tuple(r[f"n_{j}"] for j in range(1, 6))) for r in rows}
        want = counted(sigs, 5, (lambda k: k[0]) if apart else (lambda k: k))
        assert got == {k: (sum(v), v) for k, (_, v) in want.items()}


def by_pairs(values, weight):
    out = np.zeros((len(values), values.shape[1] + 1), np.int64)
    for i, v in enumerate(values):
        equal = ((values == v) & (values >= 0)).sum(axis=1)
        out[i] = np.bincount(equal, weight, values.shape[1] + 1)
        out[i, equal[i]] -= weight[i]
    return out


@pytest.mark.parametrize("direct,n,kinds", [(8, 700, 3), (50, 700, 5), (64, 900, 40), (4096, 2500, 9), (4096, 400, 300), (4096, 90, 4)])
def test_groups_are_split_without_loss(monkeypatch, direct, n, kinds):
    monkeypatch.setattr(SI, "DIRECT", direct)
    rnd = np.random.default_rng(kinds)
    for m in (1, 3, 8, 16):
        values = np.minimum(rnd.geometric(2 / kinds, (n, m)), kinds) - 1 - (rnd.random((n, m)) < 0.1)
        weight = rnd.integers(1, 4, n)
        assert (SI._solved(values, weight) == by_pairs(values, weight)).all()


def test_many_near_copies_take_no_time_of_their_subsets():
    rnd = np.random.default_rng(5)
    values = np.where(rnd.random((6000, 16)) < 0.15, rnd.integers(1, 4000, (6000, 16)), 0)
    weight, start = np.ones(6000, np.int64), time.process_time()
    got = SI._each(values, weight, np.array([6000]))
    assert time.process_time() - start < 20 and (got[:200] == by_pairs(values, weight)[:200]).all()


@pytest.mark.parametrize("name", ["sim_slots", "dist_hamming", "set_intersect_sig"])
def test_every_sequence_has_all_its_links(spark, sf, name):
    sigs = {}
    for r in slot_values(spark, sf).collect():
        sigs.setdefault(r["seq_id"], [0] * 8)[r["slot"]] = r["value"]
    want = counted(sigs, 8)
    got = {r["seq_id"]: (r["class"], tuple(r[f"n_{j}"] for j in range(1, 9))) for r in QUERIES[name](spark, sf).collect()}
    assert got == want and any(k != v[0] for k, v in want.items())


def test_signatures_of_links_make_no_row_for_each_kmer(spark, sf):
    plan = slot_values(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan


@pytest.mark.parametrize("name", ["set_intersect_sig", "dist_hamming", "sim_slots", "sim_objects"])
def test_links_of_odd_texts_without_rows_for_kmers(spark, tmp_path, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    long = "".join(np.random.default_rng(6).choice(list("ACGTn "), 1000))
    texts = [(1, long), (2, long), (3, None), (4, ""), (5, "acgt A"), (6, "ACGTAC"), (7, long[:300]), (7, long[300:400]), (None, long[500:700]), (8, long[::-1] * 20)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(SK, "race", None)
    monkeypatch.setattr(K, "kmers", None)
    got = QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len({x[0] for x in want}) == 6


def test_block_distances_of_all_pairs(spark, sf):
    sigs = {(r["seq_id"], r["block_no"]): r["sig"] for r in SK.block_sketch(seqs(spark, sf), 8, 16, 100).collect()}
    rows = QUERIES["dist_block"](spark, sf).collect()
    assert {(r[0], r[1]): ((r[2], r[3]), tuple(r[f"n_{j}"] for j in range(1, 17))) for r in rows} == counted(sigs, 16, lambda k: k[0])
    assert all(r["sum_dist"] == sum(r[f"n_{j}"] * (16 - j) for j in range(1, 17)) / 16 for r in rows)
