"""Sketches against exact similarities, within statistical bounds."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import anchors as AN
from strandwise.operators import kmers as K
from strandwise.operators import similarity as SI
from strandwise.operators import sketch as SK

from .samples import AMINO_A, AMINO_B, DNA80, HALF_A, HALF_B, PEPTIDE, words


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def agreement(sig):
    a, b = (np.array(r["sig"]) for r in sig.orderBy("seq_id").collect())
    return (a == b).mean()


def exact(spark, a, b, k, canonical):
    w = K.kmer_weights(seqs(spark, a), k, canonical)
    q = K.kmer_weights(seqs(spark, b), k, canonical).select("kmer", "weight")
    return SI.set_jaccard(w, q).first()["jaccard"], SI.probability_jaccard(w, q).first()["jp"]


def by_hand(a, b, k, canonical):
    """Set and probability Jaccard of two texts' words by plain loops."""
    x, y = Counter(words(a, k, canonical)), Counter(words(b, k, canonical))
    n, m = sum(x.values()), sum(y.values())
    share = {w: (x[w] / n, y[w] / m) for w in {*x, *y}}
    jp = sum(1 / sum(max(p / share[w][0], q / share[w][1]) for p, q in share.values()) for w in x if w in y)
    return len(x.keys() & y.keys()) / len(share), jp


@pytest.mark.parametrize("a,b,k,canonical", [(HALF_A, HALF_B, 5, False), (AMINO_A, AMINO_B, 5, False), (DNA80, DNA80[:40], 5, True), (DNA80[1:65], DNA80[35:75], 16, True)])
def test_exact_values(spark, a, b, k, canonical):
    assert exact(spark, a, b, k, canonical) == pytest.approx(by_hand(a, b, k, canonical), abs=1e-6)


@pytest.mark.parametrize("algo,weighted", [("PROB3A", True), ("PROB3", True), ("SUPER", False), ("SUPER2", False), ("OPTDENS", False), ("REVOPTDENS", False)])
@pytest.mark.parametrize("data", ["DNA", "AA"])
def test_estimates(spark, algo, weighted, data):
    a, b = (HALF_A, HALF_B) if data == "DNA" else (AMINO_A, AMINO_B)
    m = 1000 if algo.startswith(("PROB", "SUPER")) else 60
    sig = SK.sketch(seqs(spark, a, b), SK.SketchParams(5, m, algo, data), canonical=False)
    want = exact(spark, a, b, 5, False)[int(weighted)]
    assert abs(agreement(sig) - want) < (0.08 if m == 1000 else 0.25)


def test_reverse_complement_is_the_same(spark):
    rc = DNA80[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for algo in SK.KERNELS:
        p = SK.SketchParams(16, 100, algo)
        assert agreement(SK.sketch(seqs(spark, DNA80, rc), p)) == 1
        if algo not in ("HLL", "BINS"):
            assert agreement(SK.sketch(seqs(spark, DNA80, rc), p, canonical=False)) < 0.1


@pytest.mark.parametrize("algo", ["SUPER", "SUPER2", "HLL", "BINS"])
def test_merge_is_the_sketch_of_the_union(spark, algo):
    p = SK.SketchParams(6, 64, algo)
    parts = SK.merge(SK.sketch(seqs(spark, HALF_A, DNA80), p), SK.KERNELS[algo][2]).orderBy("slot").collect()
    codes = np.concatenate([SK._codes(x, 6, False, True) for x in (HALF_A, DNA80)])
    assert [r["value"] for r in parts] == pytest.approx(list(SK.KERNELS[algo][0](codes, 64)))
    assert len(SK.sketch_all(seqs(spark, HALF_A, DNA80), p).collect()) == 64


@pytest.mark.parametrize("algo", ["PROB3A", "OPTDENS", "REVOPTDENS"])
def test_one_signature_for_all(spark, algo):
    got = {r["slot"]: r["value"] for r in SK.sketch_all(seqs(spark, HALF_A, DNA80), SK.SketchParams(6, 64, algo)).collect()}
    assert sorted(got) == list(range(64)) and np.iinfo(np.int64).max not in got.values()


def test_cardinality():
    n = 20_000
    regs = SK.set_kernel(np.arange(n, dtype=np.uint64), 512)
    assert SK.set_cardinality(regs) == pytest.approx(n, rel=0.15)


def test_densified_bins_keep_the_full_ones():
    bins = np.full(100, np.iinfo(np.int64).max)
    bins[[3, 50]] = [7, 9]
    for fill in (SK.densify, SK.densify_reverse):
        out = fill(bins)
        assert out[3] == 7 and out[50] == 9 and set(out) == {7, 9}
        assert (fill(np.full(8, np.iinfo(np.int64).max)) == np.iinfo(np.int64).max).all()


def test_minhash_distance(spark):
    a = spark.createDataFrame([(0, k) for k in range(100)], "seq_id long, hash long")
    b = spark.createDataFrame([(k,) for k in range(80, 160)], "hash long")
    r = SI.minhash_distance(a, b, 500).first()
    assert (r["common"], r["total"]) == (20, 160) and r["jaccard"] == pytest.approx(0.125) and r["containment"] == pytest.approx(0.2)


def test_bottom_k_keeps_multiplicity(spark):
    got = SK.minhash(seqs(spark, "ACACACACAC"), 3, 1).first()
    assert got["cnt"] in (4, 8) and got["rank"] == 1


def test_neighbours_and_blocks(spark):
    sig = SK.sketch(seqs(spark, DNA80, DNA80, DNA80[:70] + "ACGTACGTAC", HALF_A), SK.SketchParams(8, 64, "PROB3A"))
    got = SI.neighbours(sig, 16, 5).collect()
    assert {(r["a"], r["b"]) for r in got} == {(0, 2), (2, 0)}
    b = SK.block_sketch(seqs(spark, HALF_A[:5], DNA80, ""), 3, 6, 10).groupBy("seq_id").count().collect()
    assert {r["seq_id"]: r["count"] for r in b} == {0: 1, 1: 8}
    d = SK.block_sketch(seqs(spark, DNA80), 3, 6, 10).limit(1).select(SI.block_distance(F.col("seq_id"), F.col("seq_id"), F.col("sig"), F.col("sig")).alias("d")).first()
    assert d["d"] == 1.0


def test_parameters():
    p = SK.SketchParams(8, 32, "SUPER", "AA")
    assert SK.SketchParams.from_json(p.to_json()) == p
    for bad in ({"algo": "NONE"}, {"data_type": "RNA"}):
        with pytest.raises(ValueError):
            SK.SketchParams(8, 32, **bad)


def draw(code, step, seed):
    """The kernels' uniform numbers, one at a time."""
    return float(SK._uniform(np.array([code], np.uint64), np.array([step]), seed)[0, 0])


def prob_by_hand(counts, m):
    """ProbMinHash3, one element after another."""
    least, who = [np.inf] * m, [0] * m
    rate = np.log(m / (m - 1))
    for code, weight in sorted(counts.items()):
        i = 0
        while i / weight < max(least):
            time = (i - np.log1p(-draw(code, i, 1) / m) / rate) / weight
            slot = int(draw(code, i, 1001) * m)
            if time < least[slot]:
                least[slot], who[slot] = time, code
            i += 1
    return who


def super_by_hand(codes, m):
    """SuperMinHash with whole permutations and no early end."""
    out = [np.inf] * m
    for code in codes:
        perm = list(range(m))
        for j in range(m):
            k = j + int(draw(code, j, 3) * (m - j))
            perm[j], perm[k] = perm[k], perm[j]
            out[perm[j]] = min(out[perm[j]], j + draw(code, j, 1003))
    return out


@pytest.mark.parametrize("m", [2, 7, 32])
@pytest.mark.parametrize("text,k,aa", [(DNA80, 5, False), (HALF_A, 6, False), (AMINO_A, 3, True), ("A" * 40, 4, False)])
def test_kernels_by_hand(text, k, aa, m):
    codes = SK._codes(text, k, aa, not aa)
    counts = Counter(codes.tolist())
    assert SK.prob_kernel(codes, m).tolist() == prob_by_hand(counts, m)
    assert SK.super_kernel(codes, m).tolist() == super_by_hand(counts, m)
    assert len(SK.prob_kernel(codes, 1)) == 1


def test_first_points_are_exponential():
    """Two elements of weights 1 and 3 win slots in that proportion."""
    won = [SK.first_points(np.array([2 * i, 2 * i + 1], np.uint64), np.array([1, 3]), 16)[1] % 2 for i in range(400)]
    assert np.mean(won) == pytest.approx(0.75, abs=0.02)


@pytest.mark.parametrize("algo", ["PROB3A", "PROB3", "SUPER", "SUPER2", "OPTDENS", "REVOPTDENS", "HLL"])
@pytest.mark.parametrize("k,aa", [(6, False), (20, False), (32, False), (4, True), (12, True)])
def test_one_signature_for_all_is_that_of_all_kmers(spark, algo, k, aa):
    texts = (AMINO_A, AMINO_B, AMINO_A, "") if aa else (HALF_A, DNA80, DNA80, "")
    got = SK.sketch_all(seqs(spark, *texts), SK.SketchParams(k, 32, algo, "AA" if aa else "DNA")).orderBy("slot").collect()
    codes = np.concatenate([SK._codes(x, k, aa, not aa) for x in texts])
    assert [r["value"] for r in got] == pytest.approx(list(SK.KERNELS[algo][0](codes, 32)), rel=0, abs=0)


def test_one_signature_for_nothing(spark):
    assert SK.sketch_all(seqs(spark, "", "AC"), SK.SketchParams(6, 8, "PROB3A")).count() == 0


@pytest.mark.parametrize("k,aa", [(1, False), (16, False), (32, False), (1, True), (12, True)])
def test_codes_of_words_and_back(k, aa):
    text = AMINO_A if aa else DNA80 + "T" * 32
    own = [text[i : i + k] for i in range(len(text) - k + 1)]
    codes = SK.word_codes(own, k, aa)
    assert codes.tolist() == SK._codes(text, k, aa, False).tolist()
    assert SK.code_words(codes, k, aa) == own


def test_densification_by_hand():
    none = np.iinfo(np.int64).max
    for m, k in ((8, 2), (64, 5), (101, 60)):
        bins = np.full(m, none)
        bins[(np.arange(k) * 37 + 5) % m] = np.arange(k) + 1000
        mix = lambda x: int(SK.mix64(np.array([x], np.uint64))[0])
        want = []
        for i, v in enumerate(bins):
            t = 1
            while v == none:
                v, t = bins[mix(i * 0x10001 + t) % m], t + 1
            want.append(v)
        assert SK.densify(bins).tolist() == want
        back, t = bins.tolist(), 1
        while none in back:
            for i in range(m):
                to = mix(i * 0x20003 + t) % m
                if bins[i] != none and back[to] == none:
                    back[to] = bins[i]
            t += 1
        assert SK.densify_reverse(bins).tolist() == back


def test_integers_of_superminhash_and_blocks_by_hand(spark):
    codes = SK._codes(DNA80, 8, False, True)
    assert SK.super2_kernel(codes, 16).tolist() == [int(x * (1 << 31)) for x in SK.super_kernel(codes, 16, 5)]
    got = SK.block_sketch(seqs(spark, DNA80), 8, 16, 30).orderBy("block_no").collect()
    assert [r["sig"] for r in got] == [SK.prob_kernel(codes[i : i + 30], 16).tolist() for i in (0, 30, 60)]


@pytest.mark.parametrize("algo", ["PROB3A", "PROB3"])
def test_one_against_all_by_hand(spark, algo):
    p = SK.SketchParams(6, 32, algo)
    texts = (DNA80, HALF_A, DNA80[:50], "ACG")
    got = SI.sketch_similarity(SK.sketch(seqs(spark, *texts), p), SK.sketch(seqs(spark, DNA80), p)).toPandas().set_index("seq_id").iloc[:, 0].to_dict()
    sig = [SK.prob_kernel(SK._codes(x, 6, False, True), 32) for x in texts[:3]]
    assert got == pytest.approx({i: float((s == sig[0]).mean()) for i, s in enumerate(sig)})
    with pytest.raises(Exception, match="more than one"):
        SI.sketch_similarity(SK.sketch(seqs(spark, *texts), p), SK.sketch(seqs(spark, *texts), p)).count()


def test_batched_points_are_those_of_each_set_in_few_rounds(monkeypatch):
    rnd = np.random.default_rng(8)
    own = np.sort(rnd.integers(0, 9, 3000))
    codes = rnd.integers(0, 300, 3000).astype(np.uint64) * np.uint64(977)
    for m in (1, 16, 128):
        got = SK.prob_batch(codes, own, 10, m, 20)
        assert (got[:9] == np.stack([SK.prob_kernel(codes[own == i], m) for i in range(9)])).all() and (got[9] == 0).all()
    calls, uniform = [], SK._uniform
    monkeypatch.setattr(SK, "_uniform", lambda *a: calls.append(1) or uniform(*a))
    best, _ = SK.first_points(np.array([5], np.uint64), np.array([4000]), 128)
    assert np.isfinite(best).all() and len(calls) < 60  # one stretch a round would take over a thousand


@pytest.mark.parametrize("k,aa", [(1, False), (5, False), (12, False), (31, False), (32, False), (5, True), (12, True)])
def test_codes_of_batches(k, aa):
    texts = [PEPTIDE, AMINO_A, "", AMINO_A[:k]] if aa else [DNA80, "", "ACG", HALF_A, HALF_A[:k]]
    codes, owner, place = SK.batch_codes(texts, k, aa, not aa)
    want = [(w, i, j) for i, t in enumerate(texts) for j, w in enumerate(words(t, k, not aa))]
    assert [(int(c), int(i), int(j)) for c, i, j in zip(codes, owner, place, strict=True)] == [(int(SK.word_codes([w], k, aa)[0]), i, j) for w, i, j in want]


@pytest.fixture(scope="module")
def repeated_ids(spark):
    texts = [(0, DNA80), (1, HALF_A), (0, HALF_B), (2, "ACG"), (3, None), (4, "A" * 300 + DNA80 * 3), (1, "")]
    return spark.createDataFrame(texts, "seq_id long, seq string")


def same_rows(got, want):
    assert got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect())
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each k-mer


@pytest.mark.parametrize("k,hash_fn", [(12, SK.code_hash), (20, SK.code_hash64)])
@pytest.mark.parametrize("span", [(0, None), (5, 60)])
def test_bottom_k_in_batches(repeated_ids, k, hash_fn, span):
    want = SK.bottom_k(K.kmers(repeated_ids, k, True, *span), 15, hash_fn(F.col("kmer")))
    same_rows(SK.minhash(repeated_ids, k, 15, hash_fn, *span), want)


@pytest.mark.parametrize("window,overlap,last", [(50, 10, True), (20, 15, False), (30, 0, True)])
def test_slices_in_batches(repeated_ids, window, overlap, last):
    rows = K.slice_kmers(repeated_ids, 8, window, overlap, True, last)
    same_rows(AN.slice_anchors(repeated_ids, 8, window, overlap, 4, exclude_last=last), SK.bottom_k(rows, 4, SK.code_hash(F.col("kmer")), ("seq_id", "slicepos")))


def test_block_race_and_bins_in_batches(repeated_ids):
    weights = K.blocks(repeated_ids, 8, 30).groupBy("seq_id", "block_no", "kmer").agg(F.count("*").alias("weight"))
    slots = SK.race(weights, 6, ("seq_id", "block_no")).groupBy("seq_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("s"))
    same_rows(SK.block_race(repeated_ids, 8, 6, 30), slots.select("seq_id", "block_no", F.transform("s", lambda x: x["value"]).alias("sig")))
    h = K.kmers(repeated_ids, 8, True).select("seq_id", SK.code_hash(F.col("kmer")).alias("h")).groupBy("seq_id")
    bins = h.agg(F.array(*[F.coalesce(F.min(F.when(F.col("h") % 16 == i, F.col("h"))), F.lit(0xFFFFFFFF)) for i in range(16)]).alias("sig"))
    same_rows(SK.bin_minima(repeated_ids, 8, 16), bins)


@pytest.mark.parametrize("k,m", [(1, 3), (6, 8), (8, 8), (12, 5)])
def test_race_of_sequences_in_batches(repeated_ids, k, m):
    slots = SK.race(K.kmer_weights(repeated_ids, k, True), m).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("s"))
    same_rows(SK.race_sketch(repeated_ids, k, m), slots.select("seq_id", F.transform("s", lambda x: x["value"]).alias("sig")))


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 20])
@pytest.mark.parametrize("k", [3, 6, 31])
def test_weights_do_not_depend_on_pieces(piece, k):
    texts = [[DNA80, HALF_A], [], ["ACG", ""], [DNA80 * 3 + "A" * 50], [HALF_B]]
    want = Counter((i, w) for i, x in enumerate(texts) for s in x for w in words(s, k, True))
    code, owner, weight = SK.weighted(texts, k, piece)
    assert list(zip(owner.tolist(), SK.code_words(code, k, False), weight.tolist(), strict=True)) == [(*key, n) for key, n in sorted(want.items())]
    assert all(len(x) == 0 for x in SK.weighted([[], ["AC"]], k, piece))


@pytest.mark.parametrize("k,m", [(6, 8), (8, 8)])
def test_race_times_are_those_of_the_expressions(spark, k, m):
    code = spark.range(1 << 2 * k).select(F.col("id").alias("code"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot"))
    u = (SK.inv32((F.col("code") + F.col("slot") * F.lit(SK.SLOT_STEP)).bitwiseAND(F.lit(0xFFFFFFFF))) + 0.5) / F.lit(4294967296.0)
    rows = code.select("slot", "code", (-F.log(u)).alias("time")).toPandas()
    got = SK._all_waits(k, m)[rows["slot"], rows["code"]]
    assert np.abs(got / rows["time"] - 1).max() < 1e-15
    assert all((SK._waits(np.arange(1 << 2 * k, dtype=np.uint64), slot) == x).all() for slot, x in enumerate(SK._all_waits(k, m)))


def test_registers_in_batches_hash_a_code_once(monkeypatch):
    rnd = np.random.default_rng(4)
    own = np.repeat(np.arange(50), 400)
    codes = rnd.integers(0, 500, len(own)).astype(np.uint64) * np.uint64(7919)
    hashed, mix = [0], SK.mix64
    monkeypatch.setattr(SK, "mix64", lambda x: hashed.__setitem__(0, hashed[0] + x.size) or mix(x))
    got = SK.set_batch(codes, own, 51, 32, 24)
    assert hashed[0] <= 500 * 33 + 32
    assert (got[50] == 0).all()
    for i in range(50):
        u = SK._uniform(np.unique(codes[own == i]), np.arange(32), 7)
        level = np.floor(1 - np.log(-np.log(u) / SK.SET_A) / np.log(SK.SET_B))
        assert (got[i] == np.clip(level, 0, SK.SET_Q + 1).max(axis=0)).all()
        assert (got[i] == SK.set_kernel(codes[own == i], 32)).all()
