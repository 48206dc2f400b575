"""Pieces of the independent SQL that checks the queries."""

from __future__ import annotations

from ..functions.hashing import NT_SEEDS, _rotl

D = "d AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents)"
LOW = "abcdefghijklmnopqrstuvwxyz"
AA = f"d AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, '{LOW}', '{LOW.upper()}'), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM documents)"
QUAL = "d AS (SELECT doc_id AS seq_id, regexp_replace(text, '[^ -~]', '', 'g') AS qual FROM documents)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
LETTERS = "l AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]')) AS ch FROM documents)"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def canon(x: str) -> str:
    return f"least({x}, {rc(x)})"


def k_cte(k: int, canonical: bool = False, where: str = "TRUE", src: str = "d", name: str = "k", extra: str = "") -> str:
    """CTE (seq_id, extra, pos, kmer) over ``src``; ``where`` may use pos and seq."""
    word = f"substr(seq, (pos + 1)::INT, {k})"
    return (
        f"{name} AS (SELECT seq_id, {extra} pos, {canon(word) if canonical else word} AS kmer FROM "
        f"(SELECT seq_id, {extra} seq, unnest(range(0, greatest(length(seq) - {k} + 1, 0))) AS pos FROM {src}) WHERE {where})"
    )


def code(x: str, k: int) -> str:
    return "(" + " + ".join(f"(strpos('ACGT', substr({x}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k)) + ")::BIGINT"


def inv32(src: str, col: str, out: str = "h") -> str:
    """Sub-select of ``src`` with the 32-bit mix of ``col`` as ``out``."""
    m = 4294967295
    steps = [
        f"SELECT *, (({m} - {col}) + {col} * 32768) & {m} AS z1 FROM {src}",
        "SELECT *, xor(z1, z1 >> 12) AS z2",
        f"SELECT *, (z2 + z2 * 4) & {m} AS z3",
        "SELECT *, xor(z3, z3 >> 4) AS z4",
        f"SELECT *, (z4 * 2057) & {m} AS z5",
        f"SELECT * EXCLUDE (z1, z2, z3, z4, z5), xor(z5, z5 >> 16) AS {out}",
    ]
    sql = steps[0]
    for s in steps[1:]:
        sql = f"{s} FROM ({sql})"
    return f"({sql})"


def mix64(src: str, col: str, out: str = "h") -> str:
    """Sub-select of ``src`` with the 64-bit mix of ``col`` as unsigned ``out``."""
    times = lambda x, f: f"(({x}::UHUGEINT * {f}::UHUGEINT) & 18446744073709551615::UHUGEINT)::UBIGINT"
    steps = [
        f"SELECT *, ((18446744073709551615::UHUGEINT - {col}::UHUGEINT + {col}::UHUGEINT * 2097152::UHUGEINT) & 18446744073709551615::UHUGEINT)::UBIGINT AS y1 FROM {src}",
        "SELECT *, xor(y1, y1 >> 24) AS y2",
        f"SELECT *, {times('y2', 265)} AS y3",
        "SELECT *, xor(y3, y3 >> 14) AS y4",
        f"SELECT *, {times('y4', 21)} AS y5",
        "SELECT *, xor(y5, y5 >> 28) AS y6",
        f"SELECT * EXCLUDE (y1, y2, y3, y4, y5, y6), {times('y6', 2147483649)} AS {out}",
    ]
    sql = steps[0]
    for s in steps[1:]:
        sql = f"{s} FROM ({sql})"
    return f"({sql})"


def signed(x: str) -> str:
    """An unsigned 64-bit value read as a long."""
    return f"(CASE WHEN {x} >= 9223372036854775808::UBIGINT THEN {x}::HUGEINT - 18446744073709551616::HUGEINT ELSE {x}::HUGEINT END)::BIGINT"


def inv64(src: str, col: str, out: str = "h") -> str:
    """Sub-select of ``src`` with the 64-bit mix of ``col`` as a long ``out``."""
    return f"(SELECT * EXCLUDE (z), {signed('z')} AS {out} FROM {mix64(src, col, 'z')})"


def nthash(x: str, k: int, reverse: bool = False) -> str:
    out = "0::UBIGINT"
    for i in range(k):
        base = f"substr({x}, {i + 1}, 1)"
        turn = i if reverse else k - 1 - i
        seed = {b: _rotl(NT_SEEDS[dict(zip("ACGT", "TGCA", strict=True))[b] if reverse else b], turn) for b in "ACGT"}
        out = f"xor({out}, CASE {base} WHEN 'A' THEN {seed['A']}::UBIGINT WHEN 'C' THEN {seed['C']}::UBIGINT WHEN 'G' THEN {seed['G']}::UBIGINT ELSE {seed['T']}::UBIGINT END)"
    return out


def hex16(x: str) -> str:
    return f"lpad(lower(to_hex({x})), 16, '0')"
