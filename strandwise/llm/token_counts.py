"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole.  Each token has a span of the text's UTF-8 bytes (a token can hold part
of a character, so bytes are the finer offsets), and an interval join (a merge of two sorted lists) lays the
spans over the byte spans of the document's sections, which cover the text without gaps.  A token that crosses a
boundary goes, whole, to the section that holds most of its bytes; on a tie to the earlier one.  So the
sections' counts add up to the document's.

Here sections are lines: each ends with its newline, the last with the text.  A null or empty text has one
empty section (number 0) and no tokens.  Repeated rows each give their sections.  Special-token strings in
a text are ordinary text.  Rows with null ids are counted like any other, texts are encoded whole whatever their
length, an empty table gives an empty result, and columns other than id and text are never read, so their names can't
clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Texts are handed to the tokenizer whole; results are passed on after so many sections.
SECTIONS = 50_000


class Encoder:
    """A byte-level BPE of a rank file, with each token's length in bytes."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """End of each token as a byte offset."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


def attribute(ends: np.ndarray, boundaries: np.ndarray) -> np.ndarray:
    """Section of each token: token ends and section ends are sorted byte offsets over the same text."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(boundaries, begins, "right")  # the section that holds the first byte
    last = np.searchsorted(boundaries, ends - 1, "right")
    out = first.copy()
    for k in np.flatnonzero(first != last):
        cuts = np.concatenate([[begins[k]], boundaries[first[k] : last[k]], [ends[k]]])
        out[k] = first[k] + int(np.argmax(np.diff(cuts)))  # the earliest of the largest parts
    return out


def line_sections(raw: bytes) -> np.ndarray:
    """Ends of the lines of a text in bytes."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(raw) else np.append(at, len(raw))


def section_rows(encoder: Encoder, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin in characters, characters, tokens) of each section."""
    if not text:
        return (np.zeros(1, np.int64),) * 3
    raw = text.encode("utf-8", "surrogatepass")
    boundaries = line_sections(raw)
    tokens = np.bincount(attribute(encoder.ends(text), boundaries), minlength=len(boundaries))
    if len(raw) == len(text):
        chars = boundaries
    else:
        starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        chars = starts[boundaries - 1]
    return np.concatenate([[0], chars[:-1]]), np.diff(chars, prepend=0), tokens


_encoders: dict[tuple[str, str], Encoder] = {}


def section_token_counts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, begin_char, n_chars, n_tokens), a row for each section of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = rank_file, pattern
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        encoder = _encoders[key]
        names = ["doc_id", "section", "begin_char", "n_chars", "n_tokens"]
        for b in slices(batches):
            held: list[tuple] = []
            rows: list[int] = []
            size = 0

            def out(held=held, rows=rows, b=b):
                n = [len(x[0]) for x in held]
                section = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64)
                cols = [np.concatenate([x[j] for x in held]).astype(np.int64) if held else np.zeros(0, np.int64) for j in range(3)]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(rows, n), pa.int64())), pa.array(section.astype(np.int32)), *map(pa.array, cols)], names=names)

            for k, text in enumerate(b.column(1).to_pylist()):
                held.append(section_rows(encoder, text))
                rows.append(k)
                size += len(held[-1][0])
                if size >= SECTIONS:
                    yield out()
                    held.clear()
                    rows.clear()
                    size = 0
            yield out()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, section int, begin_char long, n_chars long, n_tokens long")
