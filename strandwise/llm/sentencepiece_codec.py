"""SentencePiece (BPE) encoding by a prefix table, and decoding.

In a merge-type tokenizer every prefix of a text has one encoding, hence one last token.  A sequence of
tokens is the encoding of its text exactly if each neighbouring pair is compatible, that is if the pair's
text encodes to that pair.  So one left-to-right pass over automaton matches fills a table with each
prefix's last token (the one whose predecessor, read from the table, is compatible with it), and the ids
are read backwards from the last entry.

Null texts count as empty; an empty text has no ids and decodes to an empty text.  Texts of any length
are encoded whole in time linear in their length.  Repeated rows and rows with null ids are encoded each by itself; an
empty table gives an empty result.  ``encode_documents`` replaces columns of its own names and keeps all others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Bound on remembered words in each of a worker's two generations (four times that for pairs).
REMEMBERED = 150_000


class PieceCodec:
    """Encoder and decoder for one BPE model with identity normalisation and byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        if model.normalize("a  ﬁ") != f"{SPACE}a{SPACE}{SPACE}ﬁ":
            raise ValueError("only models with identity normalisation and a leading space are supported")
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_id = {v: k for k, v in self.byte_of.items()}
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)} | set(self.byte_of)
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if i not in special}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special}
        # A piece is a token of some text only if its own text encodes to it.
        self.whole = {p: i for p, i in self.id_of.items() if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.whole.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.pieces]
        self.letters = {p for p in self.whole if len(p) == 1}
        self.unknown = re.compile("([^" + "".join(map(re.escape, sorted(self.letters))) + "]+)")
        self.raws = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        # Texts may be cut before a space that follows another character, and at newlines, if no piece spans such a cut.
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of) or any("\n" in p for p in self.id_of):
            self.units = re.compile(r"(?s).+")
        else:
            self.units = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Merge rounds as defined: always the best-scored pair, the leftmost among equals (short texts only)."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * REMEMBERED:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def unit(self, text: str) -> list[int]:
        """Ids of one unit of text, already with escaped spaces."""
        if not self.letters.issuperset(text):
            # A character outside the vocabulary is merged with nothing, so the text falls apart there.
            out: list[int] = []
            for k, part in enumerate(self.unknown.split(text)):
                if k % 2:
                    out += [self.byte_id[x] for c in part for x in c.encode("utf-8", "surrogatepass")]
                elif part:
                    out += self.unit(part)
            return out
        last = [-1] * (len(text) + 1)  # the last token of each prefix
        pairs, lengths = self.pairs, self.lengths
        for end, (length, token) in self.automaton.iter(text):  # of the matches with one end, the longest first
            end += 1
            if last[end] < 0:
                if length == end:
                    last[end] = token
                elif (before := last[end - length]) >= 0:
                    fits = pairs.get(before << 20 | token)
                    if fits or fits is None and self.compatible(before, token):
                        last[end] = token
        ids = []
        at = len(text)
        while at:
            token = last[at]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        escaped = SPACE + text.replace(" ", SPACE)
        return [i for part in self.units.findall(escaped) for i in self.unit(part)]

    def raw(self, ids: list[int]) -> bytes:
        return b"".join([self.raws[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined to characters, and the leading space that encoding adds goes."""
        text = self.raw(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def remembered(self, part: str) -> tuple[bytes, int, bytes]:
        if (found := self.older.get(part)) is not None:
            self.words[part] = found
            return found
        ids = self.unit(part)
        found = (",".join(map(str, ids)).encode(), len(ids), self.raw(ids))
        if len(part) <= 64:
            if len(self.words) >= REMEMBERED:
                self.words, self.older = {}, self.words
            self.words[part] = found
        return found

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids and of the decoded text."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        words = self.words
        found = [words.get(part) or self.remembered(part) for part in self.units.findall(SPACE + text.replace(" ", SPACE))]
        ids = b",".join([x[0] for x in found])
        raw = b"".join([x[2] for x in found])
        return sum([x[1] for x in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw[1:] if raw[:1] == b" " else raw).hexdigest()


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The codec of a model, built once in each worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_documents(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = "decoded") -> DataFrame:
    """``docs`` with an array of ids and, if named, the decoded text; columns of these names are replaced."""
    kinds = f"{ids_col} array<int>" + (f", {decoded_col} string" if decoded_col else "")

    @F.pandas_udf(f"struct<{kinds.replace(' array', ':array').replace(' string', ':string')}>")
    def run(texts):
        import pandas as pd

        c = codec(model_file)
        ids = [c.encode(t) for t in texts]
        return pd.DataFrame({ids_col: ids} | ({decoded_col: [c.decode(i) for i in ids]} if decoded_col else {}))

    found = docs.select(F.struct("*").alias("_row"), run(F.col(text_col).cast("string")).alias("_enc")).select("_row.*", F.col("_enc").alias("_enc_"))
    names = [ids_col, *([decoded_col] if decoded_col else [])]
    return found.withColumns({n: F.col("_enc_")[n] for n in names}).drop("_enc_")


def token_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text; one map pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in slices(batches):
            n, ids, raw = zip(*[c.digest(t) for t in batch.column(1).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
