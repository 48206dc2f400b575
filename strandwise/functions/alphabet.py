"""Alphabets, packing and k-mer codes as column expressions (all inside whole-stage codegen or built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA = "ACGT"
#: Letters of the amino-acid alphabet and their five-bit codes (14 is unused).
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
AMINO_CODES = {"A": 1, "C": 2, "D": 3, "E": 4, "F": 5, "G": 6, "H": 7, "I": 8, "K": 9, "L": 10, "M": 11, "N": 12, "P": 13, "Q": 15, "R": 16, "S": 17, "T": 18, "V": 19, "W": 20, "Y": 21}
#: Four-bit codes: one bit for each base, all four for N, none for padding.
DNA4_CODES = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 15, "Z": 0}
#: Characters that an alphabet of so many bits accepts, in either case.
VALID = {2: "ACGTacgt", 4: "ACGTNacgtn", 8: "ACGTNacgtn"}
_LOW = "abcdefghijklmnopqrstuvwxyz"


def ascii_upper(s: Column) -> Column:
    return F.translate(s, _LOW, _LOW.upper())


def is_acgt(base: Column) -> Column:
    return base.rlike("^[ACGTacgt]$")


def ac_from_tg(base: Column) -> Column:
    """T to A and G to C; anything else stays."""
    return F.translate(base, "TG", "AC")


def count_invalid(s: Column, bits: int = 2) -> Column:
    """Characters outside the alphabet of ``bits`` bits; null for null."""
    return F.length(F.translate(s, VALID[bits], "")).cast("long")


def count_non_acgt(s: Column) -> Column:
    return count_invalid(s, 2)


def is_valid(base: Column, alphabet: int | str = 2) -> Column:
    if alphabet == "aa":
        return base.rlike(f"^[{AMINO_ACIDS}]$")
    return base.rlike(f"^[{VALID[int(alphabet)]}]$")


def keep_acgt(s: Column) -> Column:
    """Upper-case A, C, G and T of a text; every other character is dropped."""
    return F.translate(F.regexp_replace(s, "[^ACGTacgt]+", ""), "acgt", "ACGT")


def keep_amino_acids(s: Column) -> Column:
    return F.regexp_replace(s, f"[^{AMINO_ACIDS}]+", "")


def digits(s: Column) -> Column:
    """Bases as base-4 digits."""
    return F.translate(s, DNA, "0123")


def undigits(s: Column) -> Column:
    return F.translate(s, "0123", DNA)


def amino_code(letter: Column) -> Column:
    """Five-bit code of one letter; null outside the alphabet."""
    return F.create_map(*[F.lit(x) for kv in AMINO_CODES.items() for x in kv])[letter]


def amino_letter(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in AMINO_CODES.items() for x in (v, k)])[code]


def dna4_code(base: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in DNA4_CODES.items() for x in kv])[base]


def complement(s: Column) -> Column:
    """Complement by letter; N stays N."""
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement (order of letters is order of codes)."""
    return F.least(kmer, reverse_complement(kmer))


def push(kmer: Column, base: Column) -> Column:
    """Shift a base in on the right; the first goes."""
    return F.concat(F.substring(kmer, 2, 1 << 30), base)


def kmer_code(kmer: Column) -> Column:
    """Two bits for each base as a long (up to 31 bases); null if another character occurs."""
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), F.conv(digits(kmer), 4, 10).cast("long"))


def kmer_code32(kmer: Column) -> Column:
    """Code of up to 32 bases as a decimal."""
    return F.when(kmer.rlike("^[ACGT]{1,32}$"), F.conv(digits(kmer), 4, 10).cast("decimal(20,0)"))


def kmer_from_code(code: Column, k: int) -> Column:
    return undigits(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"))


def amino_kmer_code(kmer: Column) -> Column:
    """Five bits for each letter as a long (up to 12 letters)."""
    letters = F.split(kmer, "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: F.shiftleft(acc, 5).bitwiseOR(amino_code(c).cast("long")))


def pack2(s: Column) -> Column:
    """Four bases a byte, the first in the high bits; the last byte is padded with A (zero bits)."""
    pairs = F.regexp_extract_all(_padded(digits(s), 4, "0"), F.lit("(..)"), F.lit(1))
    hexes = "0123456789ABCDEF"
    table = F.create_map(*[F.lit(x) for i in range(16) for x in (f"{i // 4}{i % 4}", hexes[i])])
    return F.unhex(F.array_join(F.transform(pairs, lambda p: table[p]), ""))


def _padded(s: Column, to: int, with_: str) -> Column:
    return F.concat(s, F.repeat(F.lit(with_), F.pmod(F.lit(to) - F.length(s), F.lit(to)).cast("int")))


def unpack2(b: Column, n: Column) -> Column:
    """The first ``n`` bases of a packed sequence."""
    nibbles = F.regexp_extract_all(F.hex(b), F.lit("(.)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for i in range(16) for x in ("0123456789ABCDEF"[i], DNA[i // 4] + DNA[i % 4])])
    return F.array_join(F.transform(nibbles, lambda x: table[x]), "").substr(F.lit(1), n)


def pack4(s: Column) -> Column:
    """Two bases a byte; an odd end is padded with zero bits."""
    return F.unhex(_padded(F.translate(s, "ACGTN", "1248F"), 2, "0"))


def unpack4(b: Column, n: Column) -> Column:
    return F.translate(F.hex(b), "1248F0", "ACGTNZ").substr(F.lit(1), n)


def base_count(s: Column, base: str) -> Column:
    """Occurrences of one upper-case base."""
    return (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))).cast("long")
