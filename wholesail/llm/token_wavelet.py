"""Token ids in binary shards: one wavelet matrix per file.

Documents are encoded, an end id closes each, and the ids are laid out in ascending doc_id order, cut into shards at
document ends.  A shard's file holds its documents' ids and lengths and the wavelet matrix of its token ids:
bit-plane l holds bit l (from the top) of every id, in the order in which the planes above have stably parted
them (zeros first).  Planes are cut into blocks of ``BLOCK_BITS`` bits, each compressed on its own, with the number of
ones before each block beside it, so a reader gets

* ``token(i)``, the id at a place,
* ``count(id, lo, hi)``, how often an id occurs between two places,
* ``select(id, k)`` and ``places(id)``, where it occurs,

from a few blocks of the one file, without decoding it, and ``ids()`` for all of it.

``write`` returns the manifest (one row per file) as a stored table; ``read``, ``occurrences`` and ``counts`` run over it in
Spark, one file at a time in each task.  Files are written under the shared checkpoint folder (or ``path``) with a name of
their own for every attempt of a task, and only those of successful attempts are in the manifest, so a lost executor
or a repeated task leaves at most unused files.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import slices, stored

END_ID = 2
SHARD_TOKENS = 2_000_000
BLOCK_BITS = 1 << 15
MAGIC = b"WVM1"
_CACHED = 500_000  # chunks and pieces of text whose ids a worker remembers, of each
_LONG = 48  # longer ones are not remembered
RANGE_DOCS = 8192  # documents in a range of ids
MOST_RANGES = 16_384


# -- wavelet matrix in one file ----------------------------------------------------------------------
def shard_bytes(ids: np.ndarray, doc_ids: Sequence[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard: magic, blocks, directory (JSON header, then arrays), its length, magic."""
    codec = pa.Codec("zstd", compression_level=1)
    top = int(ids.max()).bit_length() if len(ids) else 0
    body, size, at, step = [MAGIC], [], len(MAGIC), BLOCK_BITS // 8
    ones, zeros = [], []  # ones before each block and all zeros, for every plane
    order = ids.astype(np.uint16 if top <= 16 else np.uint32, copy=False)
    for level in range(top):
        bit = (order & order.dtype.type(1 << (top - 1 - level))) != 0
        packed = np.packbits(bit, bitorder="little")
        per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64)
        ones.append(np.r_[0, np.cumsum(per)])
        zeros.append(len(bit) - int(ones[-1][-1]))
        for lo in range(0, len(packed), step):
            raw = packed[lo : lo + step].tobytes()
            small = codec.compress(raw, asbytes=True)
            body.append(small if len(small) < len(raw) else raw)
            size.append(len(body[-1]))
        order = np.concatenate([order[~bit], order[bit]])
    at += sum(size)
    none = [i for i, d in enumerate(doc_ids) if d is None]
    arrays = [
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8"), np.asarray(lengths, dtype="<i8"),
        np.array(size, dtype="<u4"), np.concatenate(ones).astype("<u8") if ones else np.empty(0, dtype="<u8"),
    ]
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "bits": top, "block_bits": BLOCK_BITS, "zeros": zeros, "null_docs": none}).encode()
    plain = struct.pack("<I", len(head)) + head + b"".join(a.tobytes() for a in arrays)
    packed = codec.compress(plain, asbytes=True)
    return b"".join([*body, packed, struct.pack("<QQQ", at, len(packed), len(plain)), MAGIC])


class Shard:
    """Reader of one shard's file; only the directory is read at once."""

    def __init__(self, source: pa.NativeFile):
        self.file, self.codec = source, pa.Codec("zstd")
        tail = 24 + len(MAGIC)
        end = source.size()
        at, n, plain = struct.unpack("<QQQ", self._at(end - tail, 24))
        if self._at(0, len(MAGIC)) != MAGIC or self._at(end - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        raw = self.codec.decompress(self._at(at, n), decompressed_size=plain, asbytes=True)
        (h,) = struct.unpack_from("<I", raw)
        head = json.loads(raw[4 : 4 + h])
        self.tokens, self.bits, self.block_bits, self.zeros = head["tokens"], head["bits"], head["block_bits"], head["zeros"]
        self.blocks = -(-self.tokens // self.block_bits)
        at = 4 + h
        ids = np.frombuffer(raw, "<i8", head["docs"], at)
        none = set(head["null_docs"])
        self.doc_ids = [None if i in none else int(d) for i, d in enumerate(ids)]
        self.lengths = np.frombuffer(raw, "<i8", head["docs"], at + 8 * head["docs"])
        at += 16 * head["docs"]
        self.sizes = np.frombuffer(raw, "<u4", self.bits * self.blocks, at).astype(np.int64)
        self.begins = len(MAGIC) + np.r_[0, np.cumsum(self.sizes)]
        self.ones = np.frombuffer(raw, "<u8", self.bits * (self.blocks + 1), at + 4 * len(self.sizes)).astype(np.int64).reshape(self.bits, self.blocks + 1)
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, level: int, b: int) -> np.ndarray:
        """Bits of one block, as bytes 0 and 1."""
        got = self._kept.get((level, b))
        if got is None:
            n = min(self.block_bits, self.tokens - b * self.block_bits)
            raw, plain = self._at(int(self.begins[level * self.blocks + b]), int(self.sizes[level * self.blocks + b])), -(-n // 8)
            raw = raw if len(raw) == plain else self.codec.decompress(raw, decompressed_size=plain, asbytes=True)
            if len(self._kept) >= 256:
                self._kept.clear()
            got = self._kept[level, b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little")
        return got

    def _rank(self, level: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        b, rest = divmod(i, self.block_bits)
        return int(self.ones[level, b]) + (int(self._block(level, b)[:rest].sum()) if rest else 0)

    def token(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // self.block_bits)[i % self.block_bits])
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the places ``lo .. hi`` that hold ``token`` stand behind the last plane."""
        if token < 0 or token.bit_length() > self.bits:
            return 0, 0
        for level in range(self.bits):
            if lo >= hi:
                return 0, 0
            a, b = self._rank(level, lo), self._rank(level, hi)
            bit = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if bit else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        lo, hi = max(0, lo), self.tokens if hi is None else min(hi, self.tokens)
        a, b = self._range(token, lo, hi)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind in a plane."""
        ones = self.ones[level]
        before = ones if bit else np.minimum(np.arange(self.blocks + 1) * self.block_bits, self.tokens) - ones
        b = int(np.searchsorted(before, k, side="right")) - 1
        return b * self.block_bits + int(np.flatnonzero(self._block(level, b) == bit)[k - before[b]])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, 0, self.tokens)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def places(self, token: int) -> list[int]:
        """All places of ``token``, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last: each plane's order is undone by its bits."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.tokens, dtype=kind)
        for level in reversed(range(self.bits)):
            bit = np.concatenate([self._block(level, b) for b in range(self.blocks)]).view(bool)
            back = np.empty_like(out)
            back[~bit] = out[: self.zeros[level]]
            back[bit] = out[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            out = back
        return out.astype(np.uint32)

    def document(self, place: int) -> int:
        """Number (from 0) of the document that holds a place."""
        return int(np.searchsorted(np.cumsum(self.lengths), place, side="right"))


# -- encoding ----------------------------------------------------------------------------------------
def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# what the tokenizer's own pattern does in texts of these characters, all composed letters with one lower-case letter
# each; a chunk with anything else goes to the library as it stands
_ODD = re.compile("[^ -~\n\t\rÀ-ÖØ-öø-įı-ſ]|<[|]")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ \n\t\r]+")
_BLANK = re.compile("[ \n\t\r]+")


class _Learnt(dict):
    """Ids by text, little-endian; ``ask`` finds those of a text that is asked for the first time."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, text: str) -> bytes:
        out = self.ask(text)
        if len(self) < _CACHED and len(text) <= _LONG:  # common texts come first
            self[text] = out
        return out


class Encoder:
    """Ids of whole texts as the library gives them, asking it once for each distinct piece of text.

    This tokenizer's normaliser and pattern treat a blank only as a gap: no match, composition or special token
    holds or crosses one, so the ids of a text are those of its chunks between blanks, one after the other.  A
    plain chunk's are those of its pieces, and a piece is one word of the library's model."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = _tokenizer(path)
        self.merge = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        spelt = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = str.maketrans({c: spelt.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x180))})  # as the model knows them
        self.pieces, self.chunks, self.odd = _Learnt(self._piece), _Learnt(self._chunk), _Learnt(self._odd)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._packed([t.id for t in self.merge(piece if piece.isascii() else piece.translate(self.spelling))])

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk)))

    def _odd(self, chunk: str) -> bytes:
        if _ODD.search(chunk):
            return self._packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return self.chunks[chunk.lower()]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian ids (``dtype``) of every text; null and empty texts have none."""
        plain, odd = self.chunks.__getitem__, self.odd.__getitem__
        return [b"" if not t else b"".join(map(odd, _BLANK.split(t)) if _ODD.search(t) else map(plain, t.lower().split())) for t in texts]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker: what a task has learnt (at most ``_CACHED`` pieces) serves the next."""
    return Encoder(path)


# -- on tables ---------------------------------------------------------------------------------------
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long"


def _open(file: str) -> Shard:
    system, path = fs.FileSystem.from_uri(file)
    return Shard(system.open_input_file(path))


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Encode ``docs(doc_id, text, ..)`` into shard files below ``path`` (a shared folder as a URI; by default one of its own
    in the checkpoint folder) in ascending doc_id order, null ids first, equal ids by the crc32 of their ids.
    Returns the stored manifest: ``part, seq`` (the shards' order), ``file, n_docs, n_tokens, n_bytes, start`` (ids
    before the shard).

    Every text is encoded once, where it is read; only ids cross the network, to ranges of doc_id (quantiles of that
    column).  A task holds one shard's ids; a range may give several shards, so a range of any size does.  A
    document longer than a shard makes a longer shard."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    home = (path or f"{checkpoint_dir(spark).rstrip('/')}/llm-token-shards-{uuid.uuid4().hex}").rstrip("/")
    home = home if "://" in home or home.startswith("file:") else f"file://{home}"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = min(MOST_RANGES, 1 + own.select("doc_id").count() // range_docs)
    cuts = own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    bounds = np.array(sorted(set(cuts or [])), dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        kind = encoder.dtype if end_id <= np.iinfo(encoder.dtype).max else np.dtype("<u4")
        end = np.array([end_id], dtype=kind).tobytes()
        for piece in slices(batches, max_bytes=1 << 20):
            ids = encoder.encode(piece.column("text").to_pylist())
            ids = [i + end for i in (ids if kind == encoder.dtype else [np.frombuffer(i, encoder.dtype).astype(kind).tobytes() for i in ids])]
            name = piece.column("doc_id")
            part = np.where(name.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, name.fill_null(0).to_numpy(), side="right"))
            cols = [pa.array(part.astype(np.int32)), name, pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([kind.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "tie", "width", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = seq = 0
        now = -1

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(i) for i in ids], dtype=np.int64)
            raw = shard_bytes(np.concatenate(ids), names, lengths)
            file = f"{home}/{now:06d}-{seq:06d}-{uuid.uuid4().hex}.wvm"
            system, inner = fs.FileSystem.from_uri(home)
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/{file.rsplit('/', 1)[1]}") as out:
                out.write(raw)
            row = {"part": now, "seq": seq, "file": file, "n_docs": len(names), "n_tokens": int(lengths.sum()), "n_bytes": len(raw)}
            return pa.RecordBatch.from_pylist([row], _MANIFEST)

        for b in batches:
            for part, name, width, raw in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "width", "ids")), strict=True):
                if names and (part != now or held >= shard_tokens):
                    yield flush()
                    ids, names, held, seq = [], [], 0, seq + 1
                if part != now:
                    now, seq = part, 0
                names.append(name)
                ids.append(np.frombuffer(raw, f"<u{width}"))
                held += len(ids[-1])
        if names:
            yield flush()

    coded = own.mapInArrow(encode, "part int, doc_id long, tie long, width int, ids binary")
    dealt = coded.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie").select("part", "doc_id", "width", "ids")
    return _with_starts(stored(dealt.mapInArrow(run, MANIFEST), "token-manifest"))


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def _with_starts(manifest: DataFrame) -> DataFrame:
    """``start`` of every shard: tokens of earlier parts (one row each) and of earlier shards of its part."""
    upto = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.select("part", (F.sum("all").over(upto.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("n_tokens").over(upto.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def _per_file(manifest: DataFrame, task, schema: str) -> DataFrame:
    """``task(shard, start)`` gives record batches for each file; files are dealt over the tasks by their bytes' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = _open(row["file"])
                yield from task(shard, row["start"])
                shard.file.close()

    files = manifest.select("file", "start")
    tasks = max(1, min(files.count(), 1 << 16))
    return files.repartition(tasks, "file").mapInArrow(run, schema)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Every document from the files: ``doc_id, start, n_tokens, ids_crc32`` (of its ids as little-endian 32-bit integers), and
    ``ids`` if asked for."""

    def task(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        flat = shard.ids().astype("<u4")
        cuts = [0, *accumulate(shard.lengths.tolist())]
        raw = memoryview(flat).cast("B")
        for lo in range(0, len(shard.doc_ids), 10_000):
            hi = min(lo + 10_000, len(shard.doc_ids))
            at = cuts[lo : hi + 1]
            cols = [
                pa.array(shard.doc_ids[lo:hi], pa.int64()), pa.array([start + a for a in at[:-1]], pa.int64()), pa.array(shard.lengths[lo:hi]),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
            ]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.array(at, dtype=np.int32) - at[0]), pa.array(flat[at[0] : at[-1]].astype(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in READ.split(", ")] + ["ids"] * ids)

    return _per_file(manifest, task, READ + (", ids array<long>" if ids else ""))


def occurrences(manifest: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """``token, doc_id, place`` (within the document) of every occurrence of the ids asked for, by select in the files."""
    wanted = sorted(set(tokens))

    def task(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(shard.lengths)
        for t in wanted:
            n = shard.count(t)
            for lo in range(0, n, 10_000):
                at = np.array([shard.select(t, k) for k in range(lo, min(n, lo + 10_000))], dtype=np.int64)
                doc = np.searchsorted(ends, at, side="right")
                place = at - (ends[doc] - shard.lengths[doc])
                cols = [pa.array(np.full(len(at), t, dtype=np.int64)), pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(place)]
                yield pa.RecordBatch.from_arrays(cols, ["token", "doc_id", "place"])

    return _per_file(manifest, task, "token long, doc_id long, place long")


def counts(manifest: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """``token, n``: how often each id asked for occurs in all files, by rank; ids that occur nowhere have 0."""
    wanted = sorted(set(tokens))

    def task(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([shard.count(t) for t in wanted], pa.int64())], ["token", "n"])

    spark = manifest.sparkSession
    none = spark.createDataFrame([(t, 0) for t in wanted], "token long, n long")
    return _per_file(manifest, task, "token long, n long").unionAll(none).groupBy("token").agg(F.sum("n").alias("n"))


def encoded(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs(doc_id, text, ..)`` and read them back: one row per row, ``doc_id, start, n_tokens, ids_crc32``.

    Null and empty texts hold the end id only; null ids come first; repeated rows are documents of their own;
    other columns are ignored; an empty table writes no file and gives no rows."""
    return read(write(docs, path, tokenizer, end_id, shard_tokens))
