import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from strandwise.llm.sentencepiece_codec import codec, encode_documents, token_digests  # noqa: E402

FILE = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "e", "th", " ", "  ", "\n", "\t", "é", "ﬁ", "日", "本", "😀", "1", "9", "▁", "<s>", "the", "ing", "́", "\x00", "ß", "    ", "Q", "zz", "-", "='", "//"]


def test_same_as_library_on_random_texts():
    library, own, rnd = sentencepiece.SentencePieceProcessor(model_file=FILE), codec(FILE), random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 5000, "日" * 3000, " " * 3001, "1" * 999, "ab" * 4000, "", " ", "▁"])
def test_long_and_odd_texts(text):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert codec(FILE).encode(text) == library.encode(text)


def test_digests(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in token_digests(docs, FILE).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i if i is not None else -1, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)


def test_columns_and_empty(docs, empty):
    assert token_digests(empty, FILE).count() == 0
    out = encode_documents(docs, FILE)
    assert set(docs.columns) | {"decoded"} == set(out.columns)
    row = out.filter("doc_id = 406").first()
    assert row["decoded"] == row["text"]
