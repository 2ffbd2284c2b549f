"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of symbol ids, cut into words (a run of ``▁`` and what follows
it; no piece of the vocabulary spans such a cut).  One round finds, per word, the adjacent pair of best
rank (a segmented minimum), merges all its occurrences from the left that do not overlap, and compacts
the array; rounds go on until no adjacent pair is a piece.  Each distinct word is merged once.

Why this equals one-at-a-time merging: merging all occurrences at once is only done for pieces that no
better-ranked piece extends (``Vocabulary.settled``).  For the others (``the`` is extended by the better
ranked ``▁the``) a round merges the leftmost occurrence only.  Words of very many symbols go through a
heap, which gives the same order without a pass over the whole word per merge.

The model file is read with the sentencepiece library for its pieces and scores only; encoding and
decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")
NONE = np.int64(2**62)
LONG_WORD = 4096
CACHE_WORDS = 250_000


class Vocabulary:
    """Pieces of a BPE model with byte fallback, and the table of mergeable pairs."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.eos = sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.normal = {p: i for i, p in enumerate(self.pieces) if not special[i] and not self.is_byte[i]}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(self.is_byte)}
        if any(SPACE in p.lstrip(SPACE) for p in self.normal) or len(self.byte_id) != 256:
            raise ValueError("the model needs byte fallback and no piece with a space mark inside")
        score = {i: sp.get_score(i) for i in self.normal.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.zeros(n, dtype=np.int64)
        for i, s in score.items():
            self.rank[i] = order[s]  # equal scores share a rank: the leftmost goes first
        self.settled = np.ones(n, dtype=bool)
        keys, made = [], []
        for p, i in self.normal.items():
            for k in range(1, len(p)):
                a, b = self.normal.get(p[:k]), self.normal.get(p[k:])
                if a is None or b is None:
                    continue
                keys.append((a << 32) | b)
                made.append(i)
                for part in (a, b):
                    if self.rank[i] <= self.rank[part]:
                        self.settled[part] = False
        by = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[by]
        self.made = np.array(made, dtype=np.int64)[by]
        self.pair = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        self.out = [
            bytes([int(p[3:5], 16)]) if self.is_byte[i]
            else b"" if sp.is_control(i)
            else " ⁇ ".encode() if sp.is_unknown(i)
            else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.out_array = np.array(self.out, dtype=object)
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.cache: dict[str, bytes] = {}
        self.of_point = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.normal.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i

    # -- symbols -------------------------------------------------------------------------------
    def symbols(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """``symbols, sizes``: ids of the characters of all words in one array, and the characters of each word.  A
        character outside the vocabulary is -1 - code point; it never merges."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        return self.of_point[points].astype(np.int64), sizes

    def finish(self, ids: np.ndarray) -> bytes:
        """The ids of one word as 32-bit integers, characters outside the vocabulary as their bytes' ids."""
        if ids.min(initial=0) < 0:
            flat: list[int] = []
            for i in ids.tolist():
                if i >= 0:
                    flat.append(i)
                else:
                    flat.extend(self.byte_id[b] for b in chr(-1 - i).encode())
            ids = np.array(flat)
        return ids.astype(np.int32).tobytes()

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that each adjacent pair makes, or -1."""
        key = (left << 32) | (right & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    # -- merging -------------------------------------------------------------------------------
    def merge_words(self, words: Sequence[str]) -> list[bytes]:
        """Piece ids (32-bit integers) of each word, by merge rounds over all words at once."""
        out = [b""] * len(words)
        every, sizes = self.symbols(words)
        seg = np.repeat(np.arange(len(words)), sizes)
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[k] = self.finish(np.array(self.merge_long(every[seg == k].tolist()), dtype=np.int64))
        if (sizes > LONG_WORD).any():
            short = sizes[seg] <= LONG_WORD
            every, seg = every[short], seg[short]
        sym = every
        made = np.full(len(sym), -1, dtype=np.int64)  # made[i]: what symbols i and i + 1 make
        if len(sym) > 1:
            made[:-1] = np.where(seg[:-1] == seg[1:], self.lookup(sym[:-1], sym[1:]), -1)
        done_seg, done_sym = [], []
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            count = np.diff(np.r_[first, len(seg)])
            best = np.minimum.reduceat(rank, first)
            if (best == NONE).any():  # words without a pair are finished: compact them away
                open_ = np.repeat(best < NONE, count)
                done_seg.append(seg[~open_])
                done_sym.append(sym[~open_])
                sym, seg, made, rank = sym[open_], seg[open_], made[open_], rank[open_]
                count = count[best < NONE]
                best = best[best < NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, count))
            # position inside a chain of overlapping occurrences: every second one is merged, from the left
            word = seg[at]
            new_word = np.r_[True, word[1:] != word[:-1]]
            fresh = new_word | np.r_[True, np.diff(at) > 1]
            place = np.arange(len(at))
            take = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
            # where a piece that is not settled is among the occurrences, only the leftmost of the word goes
            heads = np.flatnonzero(new_word)
            waits = np.logical_or.reduceat(~self.settled[made[at]], heads)
            take = np.where(np.repeat(waits, np.diff(np.r_[heads, len(at)])), new_word, take)
            at = at[take]
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, seg, made = sym[keep], seg[keep], made[keep]
            now = at - np.arange(len(at))  # where the merged symbols stand after compaction
            again = np.r_[now, now[now > 0] - 1]
            right = np.minimum(again + 1, len(sym) - 1)
            pair = (again + 1 < len(sym)) & (seg[again] == seg[right])
            made[again] = np.where(pair, self.lookup(sym[again], sym[right]), -1)
        if done_seg:
            dseg, dsym = np.concatenate(done_seg), np.concatenate(done_sym)
            by = np.argsort(dseg, kind="stable")
            dseg, dsym = dseg[by], dsym[by]
            cut = np.flatnonzero(np.r_[True, dseg[1:] != dseg[:-1]])
            end = np.r_[cut[1:], len(dseg)]
            raw = dsym.astype(np.int32).tobytes()
            odd = set(dseg[dsym < 0].tolist())
            for k, x, y in zip(dseg[cut].tolist(), cut.tolist(), end.tolist(), strict=True):
                out[k] = self.finish(dsym[x:y]) if k in odd else raw[4 * x : 4 * y]
        return out

    def merge_long(self, sym: list[int]) -> list[int]:
        """The same merges for one very long word, in heap order (rank, position)."""
        n = len(sym)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0:
                m = self.pair.get((sym[i] << 32) | sym[j])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), i, sym[i], sym[j], m))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            if not alive[i] or sym[i] != a or nxt[i] >= n or sym[nxt[i]] != b:
                continue
            j = nxt[i]
            alive[j] = False
            sym[i], nxt[i] = m, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [s for s, ok in zip(sym, alive, strict=True) if ok]

    # -- whole texts ---------------------------------------------------------------------------
    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of every text (without an end id); null and empty texts have none."""
        cut = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        new = list({w for ws in cut for w in ws if w not in cache})
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list({w for ws in cut for w in ws})
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            cache.update(zip(part, self.merge_words(part), strict=True))
        get = cache.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype=np.int32) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes of the pieces, one leading space (the added prefix) dropped, invalid UTF-8
        replaced; control ids give nothing."""
        raw = b"".join(self.out_array[ids].tolist())
        seen = np.flatnonzero(~self.is_control[ids])
        if len(seen) and raw[:1] == b" " and self.pieces[ids[seen[0]]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ENCODED = "doc_id long, ids array<int>, decoded string"


def encode(docs: DataFrame, model: str | None = None, digest: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ..)``: ``doc_id, ids, decoded`` (ids end with the end id),
    or with ``digest`` the columns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and ``ids``.

    Null texts count as empty: one id, the end id.  Repeated rows give repeated rows, a null doc_id stays
    null, other columns are ignored (also those named like a result), an empty table gives none.  No shuffle;
    memory is one slice of texts plus a bounded cache of words per task."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        v.cache.clear()  # a reused worker starts each task without the last one's words
        for part in slices(batches, max_bytes=1 << 20):
            texts = part.column("text").to_pylist()
            ids = [np.append(i, np.int32(v.eos)).astype(np.int32) for i in v.encode(texts)]
            back = [v.decode(i) for i in ids]
            n = np.array([len(i) for i in ids], dtype=np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(ids)))
            if digest:
                names = np.array([str(i) for i in range(len(v.pieces))], dtype=object)
                cols = [
                    part.column("doc_id"), pa.array(n),
                    pa.array([hashlib.sha256(" ".join(names[i].tolist()).encode()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat, pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])
        v.cache.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else ENCODED
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
