"""Files in and out."""

import gzip
import os

import pytest

from strandwise.operators import anchors, counting, kmers, similarity, sketch, statistics
from strandwise.sources import dumps, fastx
from strandwise.streaming.counts import read_stream, streaming_counts

from .samples import AMINO_A, DNA80, HALF_A

FASTQ = "@r1 x\nACGT\n+\nIIII\n@r2\nACNN\n+\n@@@@\n@r3\nggta\n+r3\n!!!!\n"
FASTA = ">a one\nACGT\nACG\n>b\n\nTT TT\n>c\nACGX\n"


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def test_parse():
    assert list(fastx.parse_fastx(FASTQ.splitlines(True))) == [("r1 x", "ACGT", "IIII"), ("r2", "ACNN", "@@@@"), ("r3", "ggta", "!!!!")]
    assert [x[1] for x in fastx.parse_fastx(FASTA.splitlines(True))] == ["ACGTACG", "TT TT", "ACGX"]
    for bad in ("@r\nAC\n+\nI\n", "@r\nAC\n", "ACGT\n"):
        with pytest.raises(ValueError):
            list(fastx.parse_fastx(bad.splitlines(True)))


def test_read_fastx(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.fq").write_text(FASTQ)
    with gzip.open(tmp_path / "q/b.fq.gz", "wt") as f:
        f.write(FASTQ)
    got = fastx.read_fastx(spark, str(tmp_path / "q"))
    assert got.count() == 6
    kept = fastx.retained(got).orderBy("seq_id").collect()
    assert [(r["seq_id"], r["seq"], r["qual"]) for r in kept] == [(0, "ACGT", "IIII"), (1, "GGTA", "!!!!"), (2, "ACGT", "IIII"), (3, "GGTA", "!!!!")]
    (tmp_path / "x.fa").write_text(FASTA)
    got = sorted((r["name"], r["seq"]) for r in fastx.read_fastx(spark, str(tmp_path / "x.fa")).collect())
    assert got == [("a one", "ACGTACG"), ("b", "TTTT"), ("c", "ACGX")]
    (tmp_path / "many.fq").write_text("".join(f"@n{k}\nACGT{'ACGT'[k % 4]}\n+\n@@@@@\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    many = fastx.read_fastx(spark, str(tmp_path / "many.fq"))
    assert {(r["idx"], r["name"], r["seq"]) for r in many.collect()} == {(k, f"n{k}", f"ACGT{'ACGT'[k % 4]}") for k in range(5000)}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="malformed"):
        fastx.read_fastx(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "none.fa").write_text("")
    assert fastx.read_fastx(spark, str(tmp_path / "none.fa")).count() == 0


def test_data_source(spark, tmp_path):
    spark.dataSource.register(fastx.FastxDataSource)
    (tmp_path / "a.fq").write_text(FASTQ)
    df = spark.read.format("fastx").load(str(tmp_path / "a.fq"))
    assert [(r["idx"], r["name"]) for r in df.orderBy("idx").collect()] == [(0, "r1 x"), (1, "r2"), (2, "r3")]
    with pytest.raises(Exception, match="nothing.fq"):
        spark.read.format("fastx").load(str(tmp_path / "nothing.fq")).count()


def test_parquet_round_trips(spark, tmp_path):
    df = seqs(spark, DNA80, DNA80, "ACGTTT")
    counts = counting.kmer_counts(df, 11)
    dumps.write_counts(counts, str(tmp_path / "c"))
    assert sorted(dumps.read_counts(spark, str(tmp_path / "c")).collect()) == sorted(counts.filter("cnt >= 2").collect())
    dumps.write_unique(counting.unique_kmers(df, 6), str(tmp_path / "u"))
    p = sketch.SketchParams(8, 32, "PROB3A")
    sig = sketch.sketch(df, p)
    dumps.write_signatures(sig, p, str(tmp_path / "s"))
    back, q = dumps.read_signatures(spark, str(tmp_path / "s"))
    assert q == p and sorted(map(str, back.collect())) == sorted(map(str, sig.collect()))
    blocks = sketch.block_sketch(df, 8, 16, 20)
    dumps.write_signatures(blocks, p, str(tmp_path / "b"), ["seq_id"])
    assert dumps.read_signatures(spark, str(tmp_path / "b"))[0].count() == blocks.count()
    a = anchors.slice_anchors(df, 8, 50, 10, 4)
    dumps.write_key_values(a, anchors.anchor_index(a), str(tmp_path / "kv"))
    dumps.write_edges(similarity.neighbours(sig, 8, 3), str(tmp_path / "e"))


def test_text_dumps(spark, tmp_path):
    df = seqs(spark, DNA80, "ACGT")
    dumps.write_base_distribution(statistics.base_distribution(df), str(tmp_path / "bases"))
    lines = [x.split() for r in spark.read.text(str(tmp_path / "bases")).collect() for x in [r[0]]]
    assert len(lines) == 101 and all(len(x) == 4 for x in lines) and float(lines[25][0]) == 0.5
    dumps.write_read_lengths(statistics.read_lengths(df), str(tmp_path / "lengths"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "lengths")).collect()} == {"80 1", "4 1"}


def test_binary_round_trips(spark, tmp_path):
    df = seqs(spark, DNA80, DNA80[:60])
    counts = counting.kmer_counts(df, 12)
    data = dumps.multi_to_binary(counts, 12)
    assert sorted(dumps.multi_from_binary(data, "data").collect()) == sorted(counts.filter("cnt >= 2").collect())
    once = counting.unique_kmers(df, 12)
    assert sorted(dumps.unique_from_binary(dumps.unique_to_binary(once, 12), "data").collect()) == sorted(once.collect())
    sig = sketch.sketch(df, sketch.SketchParams(12, 16, "PROB3A"))
    parts = dumps.signatures_to_binary(sig, 12).orderBy("part").coalesce(1)
    assert [r["sig"] for r in dumps.signatures_from_binary(parts, "data").collect()] == [r["sig"] for r in sig.orderBy("seq_id").collect()]
    bad = spark.createDataFrame([(bytearray(20),)], "data binary")
    with pytest.raises(Exception, match="not a dump"):
        dumps.multi_from_binary(bad, "data").count()


def test_wide_and_amino_acid_dumps(spark):
    df = seqs(spark, DNA80, DNA80[:60])
    for k in (16, 17, 31, 32):
        counts = counting.kmer_counts(df, k)
        assert sorted(dumps.multi_from_binary(dumps.multi_to_binary(counts, k), "data").collect()) == sorted(counts.filter("cnt >= 2").collect())
    proteins = seqs(spark, AMINO_A, AMINO_A)
    for k in (1, 6, 7, 12):
        counts = kmers.kmers(proteins, k).groupBy("kmer").count().withColumnRenamed("count", "cnt")
        data = dumps.multi_to_binary(counts, k, "AA")
        assert sorted(dumps.multi_from_binary(data, "data", "AA").collect()) == sorted(counts.filter("cnt >= 2").collect())
        places = kmers.kmers(seqs(spark, AMINO_A), k).select("kmer", "seq_id", "pos")
        assert sorted(dumps.unique_from_binary(dumps.unique_to_binary(places, k, "AA"), "data", "AA").collect()) == sorted(places.collect())


def test_dumps_lie_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dumps, "PART_ROWS", 4)
    blocks = sketch.block_race(seqs(spark, DNA80, "ACG", HALF_A), 6, 8, 10)
    rows = blocks.orderBy("seq_id", "block_no").collect()
    assert len(rows) == 14
    n = dumps.write_files(dumps.blocks_to_binary(blocks, 6, 10), str(tmp_path / "d"))
    files = [f for f in os.listdir(tmp_path / "d") if not f.startswith(("_", "."))]
    assert len(files) == n >= 4
    back = dumps.blocks_from_binary(spark.read.format("binaryFile").load(str(tmp_path / "d")))
    assert [(r["seq_id"], r["block_no"], r["sig"]) for r in back.orderBy("seq_id", "block_no").collect()] == [(r["seq_id"], r["block_no"], r["sig"]) for r in rows]
    assert {(r["k"], r["block"]) for r in back.collect()} == {(6, 10)}


def test_values_beyond_a_layout_are_errors(spark):
    sig = spark.createDataFrame([(0, [1 << 40])], "seq_id long, sig array<long>")
    with pytest.raises(Exception, match="32-bit"):
        dumps.signatures_to_binary(sig, 8).count()
    far = spark.createDataFrame([("ACGT", 1 << 40, 0)], "kmer string, seq_id long, pos int")
    with pytest.raises(Exception, match="too large"):
        dumps.unique_to_binary(far, 4).count()


def test_streaming_counts(spark, tmp_path):
    for k, text in enumerate(("ACGTACGT", "ttacgtxx")):
        spark.createDataFrame([(k, text)], "doc_id long, text string").write.parquet(str(tmp_path / f"in/{k}"))
    stream = streaming_counts(read_stream(spark, str(tmp_path / "in/*"), 1), 4)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("kmer_stream").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["kmer"]: r["cnt"] for r in spark.table("kmer_stream").collect()}
    want = counting.kmer_counts(seqs(spark, "ACGTACGT", "TTACGT"), 4)
    assert got == {r["kmer"]: r["cnt"] for r in want.collect()}


def test_command_line(spark, tmp_path):
    from strandwise.__main__ import parser, run

    (tmp_path / "r.fq").write_text("".join(f"@r{k}\n{DNA80}\n+\n{'I' * 80}\n" for k in range(3)))
    for words in ("stats", "count -k 12", "unique -k 12", "sketch -k 8 -s 16 --neighbours 3", "sketch -k 8 -s 16 -b 20", "sketch -k 4 -s 16 --data AA --algo SUPER", "anchors -k 8 -w 50 --overlap 10 -n 4", "quality"):
        what, *rest = words.split()
        run(spark, parser().parse_args([what, "-f", str(tmp_path / "r.fq"), "-o", str(tmp_path / "out" / words.replace(" ", "_")), *rest]))
    assert spark.read.parquet(str(tmp_path / "out/count_-k_12")).filter("cnt < 3").count() == 0
    assert {r["q8"] for r in spark.read.parquet(str(tmp_path / "out/quality")).collect()} == {"7" * 80}
