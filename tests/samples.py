"""Generated sequences that the tests share."""

import random

_rnd = random.Random(20)


def bases(n: int) -> str:
    return "".join(_rnd.choices("ACGT", k=n))


def acids(n: int) -> str:
    return "".join(_rnd.choices("ACDEFGHIKLMNPQRSTVWY", k=n))


#: 80 bases; 72 that begin again; two that share half; two proteins that share half; a short protein.
DNA80 = bases(80)
DNA72 = DNA80[:46] + DNA80[:26]
HALF_A = bases(60)
HALF_B = HALF_A[:32] + HALF_A[4:30]
AMINO_A = acids(98)
AMINO_B = AMINO_A[:46] + AMINO_A[2:48]
PEPTIDE = acids(32)


def reverse_complement(x: str) -> str:
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def words(text: str, k: int, canonical: bool = False) -> list[str]:
    out = [text[i : i + k] for i in range(len(text) - k + 1)]
    return [min(w, reverse_complement(w)) for w in out] if canonical else out
