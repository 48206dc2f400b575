"""Command line: ``python -m strandwise stats|count|unique|sketch|anchors|quality -f READS -o FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import anchors as AN
from .operators import counting as C
from .operators import qualities as QU
from .operators import similarity as SI
from .operators import sketch as SK
from .operators import statistics as ST
from .sources import dumps, fastx


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwise", description=__doc__)
    kinds = top.add_subparsers(dest="what", required=True)

    def kind(name: str, text: str) -> argparse.ArgumentParser:
        p = kinds.add_parser(name, help=text)
        p.add_argument("-f", "--file", required=True, help="FASTA or FASTQ file, folder or pattern")
        p.add_argument("-o", "--out", required=True, help="folder for the results")
        return p

    kind("stats", "base composition, read lengths and load totals")
    p = kind("count", "canonical k-mers with their counts")
    p.add_argument("-k", type=int, default=16)
    p.add_argument("--least", type=int, default=2, help="smallest count to keep")
    p.add_argument("--bits", type=int, help="width of a saturating counter")
    p = kind("unique", "k-mers seen once, with read and place")
    p.add_argument("-k", type=int, default=16)
    p = kind("sketch", "signatures of reads, or of blocks of reads")
    p.add_argument("-k", type=int, default=8)
    p.add_argument("-s", "--size", type=int, default=200)
    p.add_argument("--algo", default="PROB3A", choices=sorted(SK.KERNELS))
    p.add_argument("--data", default="DNA", choices=["DNA", "AA"])
    p.add_argument("-b", "--block", type=int, help="bases of a block")
    p.add_argument("--neighbours", type=int, help="also write so many nearest neighbours of each read")
    p = kind("anchors", "bottom hashes of overlapping slices, and their index")
    p.add_argument("-k", type=int, default=16)
    p.add_argument("-w", "--window", type=int, default=1000)
    p.add_argument("--overlap", type=int, default=100)
    p.add_argument("-n", type=int, default=10)
    kind("quality", "qualities in eight levels")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    reads = fastx.read_fastx(spark, args.file)
    if args.what == "quality":
        own = reads.filter("qual IS NOT NULL").select(F.struct("file", "idx").alias("seq_id"), "qual")
        return QU.compress(own).select("seq_id.*", "q8").write.mode("overwrite").parquet(args.out)
    if args.what == "stats":
        seqs = fastx.retained(reads)
        dumps.write_base_distribution(ST.base_distribution(seqs), f"{args.out}/bases")
        dumps.write_read_lengths(ST.read_lengths(seqs), f"{args.out}/lengths")
        return ST.load_totals(reads).write.mode("overwrite").json(f"{args.out}/totals")
    seqs = reads.select("idx", "seq").withColumnRenamed("idx", "seq_id") if getattr(args, "data", "DNA") == "AA" else fastx.retained(reads)
    if args.what == "count":
        return dumps.write_counts(C.kmer_counts(seqs, args.k, counter_bits=args.bits), args.out, args.least)
    if args.what == "unique":
        return dumps.write_unique(C.unique_kmers(seqs, args.k), args.out)
    if args.what == "anchors":
        a = AN.slice_anchors(seqs, args.k, args.window, args.overlap, args.n)
        return dumps.write_key_values(a, AN.anchor_index(a), args.out)
    params = SK.SketchParams(args.k, args.size, args.algo, args.data)
    if args.block:
        return dumps.write_signatures(SK.block_sketch(seqs, args.k, args.size, args.block), params, args.out)
    sigs = SK.sketch(seqs, params)
    dumps.write_signatures(sigs, params, args.out)
    if args.neighbours:
        stored, _ = dumps.read_signatures(spark, args.out)
        dumps.write_edges(SI.neighbours(stored, max(1, args.size // 4), args.neighbours), f"{args.out}/neighbours")
    return None


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName(f"strandwise {args.what}").getOrCreate()
    run(spark, args)
    spark.stop()


if __name__ == "__main__":
    main()
