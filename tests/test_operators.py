"""Operators on literal sequences with known results."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.functions import alphabet as A
from strandwise.functions import hashing as H
from strandwise.functions import quality as Q
from strandwise.operators import anchors, counting, kmers, qualities, ranks, statistics
from strandwise.sources import dumps, tables

from .samples import AMINO_A, DNA72, DNA80, PEPTIDE, words
from .samples import reverse_complement as A_rc



def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,bits,packed", [("ACGT", 4, "1248"), ("ACGTA", 4, "124810"), ("ACGTC", 2, "1B40"), ("", 2, "")])
def test_pack(spark, text, bits, packed):
    pack = A.pack2 if bits == 2 else A.pack4
    assert one(spark, F.hex(pack(F.col("s"))), s=text) == packed
    unpack = A.unpack2 if bits == 2 else A.unpack4
    assert one(spark, unpack(pack(F.col("s")), F.length("s")), s=text) == text


@pytest.mark.parametrize("text", ["GGNATCXA-CT", "ggNatcxA-cT", "NNGGATCACTN"])
def test_filter(spark, text):
    assert one(spark, A.keep_acgt(F.col("s")), s=text) == "GGATCACT"


@pytest.mark.parametrize("text,rc", [("AACCGT", "ACGGTT"), ("GATTACAG", "CTGTAATC"), ("ACGT", "ACGT"), ("T", "A")])
def test_reverse_complement(spark, text, rc):
    assert one(spark, A.reverse_complement(F.col("s")), s=text) == rc
    assert one(spark, A.canonical(F.col("s")), s=text) == min(text, rc)


def test_codes(spark):
    assert one(spark, A.kmer_code(F.col("s")), s="ACGT") == 27
    assert one(spark, A.kmer_from_code(A.kmer_code(F.col("s")), 16), s=DNA80[:16]) == DNA80[:16]
    assert one(spark, A.kmer_code(F.col("s")), s="ACGN") is None
    assert int(one(spark, A.kmer_code32(F.col("s")), s="T" * 32)) == (1 << 64) - 1
    assert one(spark, A.amino_kmer_code(F.col("s")), s="AQ") == 32 + 15
    assert one(spark, A.push(F.col("s"), F.lit("G")), s="ACT") == "CTG"


def test_kmers_are_substrings(spark):
    got = {(r["pos"], r["kmer"]) for r in kmers.kmers(seqs(spark, DNA80), 16).collect()}
    assert got == {(i, DNA80[i : i + 16]) for i in range(65)}
    canon = {(r["pos"], r["kmer"]) for r in kmers.kmers(seqs(spark, DNA80), 7, True).collect()}
    assert canon == set(enumerate(words(DNA80, 7, True)))


def test_long_sequences_are_cut_without_loss(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choices("ACGT", k=3 * kmers.CHUNK + 5))
    got = kmers.kmers(seqs(spark, text), 9).agg(F.count("*"), F.countDistinct("pos"), F.max("pos")).first()
    assert tuple(got) == (len(text) - 8,) * 2 + (len(text) - 9,)
    around = kmers.kmers(seqs(spark, text), 9, True).filter(F.abs(F.col("pos") - kmers.CHUNK) < 12).collect()
    assert len(around) == 23 and all(r["kmer"] == min(text[r["pos"] : r["pos"] + 9], A_rc(text[r["pos"] : r["pos"] + 9])) for r in around)


def test_short_null_and_ranges(spark):
    df = spark.createDataFrame([(0, "ACG"), (1, ""), (2, None)], "seq_id long, seq string")
    assert kmers.kmers(df, 4).count() == 0 and kmers.kmers(df, 4, True).count() == 0
    rows = kmers.kmer_range(seqs(spark, DNA80[:50]), 16, 3, 25).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(3, 10))
    with pytest.raises(ValueError):
        kmers.kmer_range(df, 4, 5, 5)
    aa = [r["kmer"] for r in kmers.kmer_range(seqs(spark, PEPTIDE), 4, 3, 10).orderBy("pos").collect()]
    assert aa == words(PEPTIDE, 4)[3:7]
    assert kmers.kmers(seqs(spark, PEPTIDE), 8).orderBy(F.desc("pos")).first()["kmer"] == PEPTIDE[-8:]


def test_weights(spark):
    w = kmers.kmer_weights(seqs(spark, DNA80), 3).collect()
    assert {r["kmer"]: r["weight"] for r in w} == Counter(words(DNA80, 3))
    w = kmers.kmer_weights(seqs(spark, DNA72), 15).groupBy("weight").count().collect()
    assert {r["weight"]: r["count"] for r in w} == Counter(Counter(words(DNA72, 15)).values()) and len(w) == 2


def test_counts(spark):
    df = seqs(spark, *["ACGTAC"] * 300)
    assert counting.kmer_counts(df, 6, False, counter_bits=8).first()["cnt"] == 255
    assert counting.kmer_counts(df, 6, False).first()["cnt"] == 300
    both = counting.kmer_counts(seqs(spark, DNA80, A_rc(DNA80)), 11)
    assert {r["cnt"] for r in both.collect()} == {2}
    with pytest.raises(ValueError):
        counting.kmer_counts(df, 33)


def nt_by_hand(text):
    """One base after the other: turn the hash left by one bit and add the base's seed."""
    h = 0
    for b in text:
        h = ((h << 1 | h >> 63) & ((1 << 64) - 1)) ^ H.NT_SEEDS[b]
    return h


@pytest.mark.parametrize("k", [1, 10, 31, 64, 70])
def test_rolling_nthash(spark, k):
    text = DNA80 * 3
    got = {r["pos"]: (r["forward"], r["reverse"]) for r in kmers.rolling_nthash(seqs(spark, text, "", "ACG"[: min(3, k - 1)]), k).filter("seq_id = 0").collect()}
    rows = kmers.kmers(seqs(spark, text), k).select("pos", H.nthash(F.col("kmer"), k).alias("f"), H.nthash(F.col("kmer"), k, True).alias("r"))
    assert got == {r["pos"]: (r["f"], r["r"]) for r in rows.collect()} and len(got) == 240 - k + 1


def test_nthash(spark):
    forward = one(spark, H.unsigned_text(H.nthash(F.col("s"), 16)), s=DNA80[:16])
    back = one(spark, H.unsigned_text(H.nthash(F.col("s"), 16, True)), s=DNA80[:16])
    assert (int(forward, 16), int(back, 16)) == (nt_by_hand(DNA80[:16]), nt_by_hand(A_rc(DNA80[:16])))
    x = one(spark, H.nthash_canonical(H.nthash(F.col("s"), 16), H.nthash(F.col("s"), 16, True)), s=DNA80[:16])
    assert (x["strand"] == 1) == (int(back, 16) < int(forward, 16))
    assert one(spark, H.unsigned_text(H.nthash(F.col("s"), 16, True)), s=A_rc(DNA80[:16])) == forward
    assert one(spark, H.inv32(F.col("s")), s=123456789) == 2827297960
    assert one(spark, H.byte_swapped32(F.col("s")), s=0x01020304) == 0x04030201


def test_hashes_in_batches(spark):
    rows = spark.range(500).select(H.inv64("id").alias("h"), F.col("id")).collect()
    assert len({r["h"] for r in rows}) == 500
    multi = spark.range(3).select("id", H.nthash_multi(8, 4)("id").alias("m")).collect()
    assert all(len(r["m"]) == 4 and r["m"][0] == r["id"] for r in multi)


@pytest.mark.parametrize("q,level", [(0x20, 0), (0x24, 0), (0x25, 1 - 1 + 1), (0x27, 1), (0x28, 2), (0x2A, 2), (0x2B, 3), (0x31, 5), (0x34, 6), (0x36, 6), (0x37, 7), (0x38, 7), (0x49, 7)])
def test_remap(spark, q, level):
    assert Q.level_of(q) == level
    assert one(spark, Q.remap8(F.col("q")), q=q) == level


def test_quality_lookups(spark):
    df = spark.createDataFrame([(0, "%%(+"), (1, ""), (2, None)], "seq_id long, qual string")
    c = qualities.compress(df)
    assert {r["seq_id"]: r["q8"] for r in c.collect()} == {0: "1123", 1: ""}
    assert qualities.read_block(c, 1, 3).filter("seq_id = 0").first()["q8"] == "12"
    assert [r["q8"] for r in qualities.decompress(c).orderBy("pos").collect()] == [1, 1, 2, 3]
    every = "".join(map(chr, range(0x20, 0x7F)))
    assert qualities.compress(spark.createDataFrame([(0, every)], "seq_id long, qual string")).first()["q8"] == "".join(str(Q.level_of(ord(x))) for x in every)
    assert {r["seq_id"]: (r["len"], r["bits"]) for r in qualities.describe(c).collect()} == {0: (4, 2), 1: (0, 0)}
    assert qualities.read_one(c, 1).count() == 1


def reference_groups(sizes, n):
    """The greedy description, item by item."""
    step = max(1, int(sum(sizes) / n + 0.5))
    out, total, closed = [], 0, 0
    for i, s in enumerate(sizes):
        goal = step * (closed + 1)
        if total + s > goal:
            out.append(i + 1 if total + s - goal <= goal - total else i)
            closed += 1
        total += s
    if not out or out[-1] < len(sizes):
        out.append(len(sizes))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_groups(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.randrange(100) for _ in range(400)] if seed else [1, 2, 500, 3, 4, 5, 600, 1, 1]
    n = 20 if seed else 4
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, size long").repartition(3)
    got = [r["frontier"] for r in statistics.equal_groups(df, n).orderBy("group_no").collect()]
    assert got == reference_groups(sizes, n)


def test_running_totals(spark):
    rnd = random.Random(3)
    v = [rnd.randrange(50) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(v)), "k long, v long").repartition(7)
    got = ranks.running(df, "k", {"before": "v"}, {"low": "v"}).orderBy("k").collect()
    assert [r["row_index"] for r in got] == list(range(1000))
    assert [r["before"] for r in got] == [sum(v[:i]) for i in range(1000)]
    assert [r["low"] for r in got] == [min(v[: i + 1]) for i in range(1000)]


def test_statistics(spark):
    df = seqs(spark, "AACC", "ACGT", "A" * 99 + "C")
    d = statistics.base_distribution(df)
    assert d.count() == 404
    assert d.filter("base = 'A' AND frac > 0").agg(F.sum("frac")).first()[0] == pytest.approx(1)
    assert d.filter("base = 'A' AND percent = 99").first()["frac"] == pytest.approx(1 / 3)
    totals = statistics.load_totals(seqs(spark, "ACGT", "ACNN", "x")).first()
    assert tuple(totals) == (3, 9, 3, 2)
    assert [r["seq"] for r in tables.valid_reads(seqs(spark, "acGT", "ACNN", "", None)).collect()] == ["ACGT", ""]


def test_slices_and_anchors(spark):
    df = seqs(spark, DNA80, "ACG", "")
    s = kmers.slices(df, 50, 10).filter("seq_id = 0").orderBy("beg").collect()
    assert [(r["beg"], r["end"]) for r in s] == [(0, 50), (40, 79)]
    a = anchors.slice_anchors(df, 8, 50, 10, 4)
    assert a.filter("seq_id = 1").count() == 0 and a.filter("seq_id = 0").count() == 8
    arrays = anchors.anchor_arrays(a).withColumn("back", anchors.value_from_text(anchors.value_text(F.col("anchors"))))
    assert arrays.filter("back <> anchors").count() == 0
    with pytest.raises(ValueError):
        kmers.slices(df, 10, 10)
    assert {r["block_no"] for r in kmers.blocks(df, 8, 10).filter("seq_id = 0").collect()} == set(range(8))


def test_return_times(spark):
    got = kmers.return_times(kmers.kmers(seqs(spark, "ACACAC"), 2)).collect()
    assert {(r["kmer"], r["pos"], r["gap"]) for r in got} == {("AC", 2, 2), ("AC", 4, 2), ("CA", 3, 2)}


def test_counters_combine_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, DNA80 * 40) for i in range(40)] + [(99, None), (98, "AC")], "seq_id long, seq string")
    got = counting.partitioned_counts(df, 13, 2)
    want = counting.kmer_counts(df, 13)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    # k-mers are summed before they are dealt out, and not to as few tasks as there are counters.
    assert "hashpartitioning(kmer" not in plan and "hashpartitioning(bucket" in plan and "REPARTITION_BY_NUM" not in plan.split("hashpartitioning(bucket")[1].split("\n")[0]


def test_codes_of_amino_acids_go_through_a_dump(spark):
    df = spark.createDataFrame([(0, AMINO_A), (1, AMINO_A[20:]), (2, None), (3, "ACD")], "seq_id long, seq string")
    back = dumps.multi_from_binary(dumps.multi_to_binary(counting.code_counts(df, 12, False, True), 12, "AA"), "data", "AA")
    assert {r["kmer"]: r["cnt"] for r in back.collect()} == {AMINO_A[i : i + 12]: 2 for i in range(20, len(AMINO_A) - 11)}
