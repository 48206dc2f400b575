import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandwise.llm.token_counts import Encoder, attribute, section_token_counts  # noqa: E402

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(encoder, text):
    """Tokens of each line by walking over bytes."""
    raw = (text or "").encode()
    parts = raw.split(b"\n")
    lines = [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    counts, at = [0] * len(lines), 0
    for t in encoder.encoding.encode_ordinary(text or ""):
        n = int(encoder.lengths[t])
        own = owner[at : at + n]
        counts[max(sorted(set(own)), key=lambda s: ((own == s).sum(), -s))] += 1
        at += n
    return [(k, len(x.decode()), c) for k, (x, c) in enumerate(zip(lines, counts, strict=True))]


def test_against_brute_force(spark, docs, rows, empty):
    encoder = Encoder(FILE, public_tokenizers.PATTERN)
    odd = [(1, "a\n\n\n  b\n \n\n\tx", "", "", 0), (2, "\n" * 9 + "é\n日本\n", "", "", 0), (3, "<|endoftext|>\n x", "", "", 0)]
    for df, src in ((docs, rows), (spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), odd)):
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["section"], r["n_chars"], r["n_tokens"]) for r in section_token_counts(df, FILE, public_tokenizers.PATTERN).collect())
        want = sorted((-1 if i is None else i, *x) for i, t, *_ in src for x in brute(encoder, t))
        assert got == want
    assert section_token_counts(empty, FILE, public_tokenizers.PATTERN).count() == 0


def test_rule():
    assert attribute(np.array([4, 5]), np.array([3, 5])).tolist() == [0, 1]
    assert attribute(np.array([4]), np.array([2, 4])).tolist() == [0]  # a tie goes to the earlier section
    assert attribute(np.array([9]), np.array([1, 2, 9])).tolist() == [2]
