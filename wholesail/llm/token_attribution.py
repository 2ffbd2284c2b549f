"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole, so that counts add up to the document's and no token depends on where a
section was cut.  Each token covers a span of characters (from the bytes of its piece); the spans are
interval-joined with the document's sections by binary search.  A token that crosses a boundary belongs to the
section that holds its first character (``rule='first'``) or its last (``'last'``); a character whose bytes are split
over tokens is in each of their spans.

The encoding is byte-level BPE with a public vocabulary, whose path is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """``(encode, lengths)``: a function from text to ids, and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary, lengths


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids, first, last``: of each token its id and the places of its first and last character."""
    encode, lengths = encoder(path)
    ids = np.array(encode(text), dtype=np.int64)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    ends = np.cumsum(lengths[ids])
    return ids, char[ends - lengths[ids]], char[ends - 1]


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the text's lines; a line's end is behind its line feed, so lines cover the text."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10)
    start = np.r_[0, at + 1]
    end = np.r_[at + 1, len(text)]
    return (start, end) if start[-1] < len(text) or len(start) == 1 else (start[:-1], end[:-1])


RESULT = "doc_id long, section int, start int, end int, n_tokens long, doc_tokens long"


def attribute(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """One row per line of each row of ``docs(doc_id, text, ..)``: ``doc_id, section`` (from 0), ``start, end``
    (characters), ``n_tokens`` attributed to it and ``doc_tokens`` of the whole text.  With a column ``sections``
    (array of structs with ``start`` and ``end``, any order, overlaps allowed) those are taken in place of the lines.

    A null or empty text is one section of no characters and no tokens (with ``sections``: those given, no tokens).
    Null bounds count as empty sections.  Repeated rows and null ids stay; other columns are ignored; an empty table
    gives none.  Nothing is shuffled."""
    if rule not in ("first", "last"):
        raise ValueError("rule is 'first' or 'last'")
    path = path or default_vocabulary()
    given = "sections" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=4 << 20):
            own = part.column("sections").to_pylist() if given else None
            starts, ends, counts, wholes, sizes = [], [], [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                text = text or ""
                _, first, last = token_spans(text, path)
                place = first if rule == "first" else last
                if given:
                    own_k = own[k] or []
                    start = np.array([s["start"] or 0 if s else 0 for s in own_k], dtype=np.int64)
                    end = np.array([s["end"] or 0 if s else 0 for s in own_k], dtype=np.int64)
                else:
                    start, end = lines_of(text)
                n = np.searchsorted(place, np.maximum(start, end), "left") - np.searchsorted(place, start, "left")
                starts.append(start)
                ends.append(end)
                counts.append(n)
                wholes.append(np.full(len(n), len(place), dtype=np.int64))
                sizes.append(len(n))
            each = np.repeat(np.arange(part.num_rows), sizes)
            section = np.concatenate([np.arange(s) for s in sizes]) if sizes else np.zeros(0)
            join = lambda xs, t: pa.array(np.concatenate(xs).astype(t))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(each)), pa.array(section.astype(np.int32)), join(starts, np.int32), join(ends, np.int32), join(counts, np.int64), join(wholes, np.int64)],
                ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"],
            )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if given:
        columns.append(F.transform("sections", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))).alias("sections"))
    return docs.select(*columns).mapInArrow(run, RESULT)
