"""Token ids in directly addressable codes.

A token's code is the place of its id among the ids of its file, most frequent first, so that the 256 most frequent ones take
one chunk. A code is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every token, level 1 the next chunk of those
codes that need one, and so on; a bitmap per level marks the codes that go on, and a rank directory (ones before each block of
512 bits) finds a code's place in the next level. So any token is read by position, with no block to decode.

File, little-endian: ``DAC2``, u32 levels, u64 documents, u64 tokens; per document u8 "has an id", i64 doc_id; u64 token
offsets (documents + 1); u64 number of ids, the ids by code (u32 each); per level u64 length, its chunks, its bitmap, its rank
directory (u64 each). Documents ascend by doc_id within a file and over the files in order of the manifest.
"""

from __future__ import annotations

import io
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _words
from ._common import ensure_dir, release, shared_dir, ship, table, text_only
from ._words import chunks

ship(__name__)

BLOCK_BITS = 512
FILE_TOKENS = 8 << 20
DENSE_IDS = 1 << 22  # ids below this are counted in an array of all of them
COUNTED = 1 << 20  # tokens counted at once
CACHE_UNITS = 1_000_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: what splits the texts of such a vocabulary
MANIFEST = "part int, seq int, path string, docs long, tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def by_frequency(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, most frequent first (ties: smaller first), and each token's place among them."""
    if len(flat) and flat.max() >= DENSE_IDS:
        ids, place = np.unique(flat, return_inverse=True)
    else:
        ids, place = np.arange(int(flat.max()) + 1 if len(flat) else 0, dtype=np.uint32), flat
    n = np.zeros(len(ids), np.int64)
    for k in range(0, len(place), COUNTED):
        n += np.bincount(place[k : k + COUNTED], minlength=len(ids))
    order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    code = np.zeros(len(ids), np.uint32)
    code[order] = np.arange(len(order))
    return ids[order], code[place]


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file's bytes for documents with these token ids."""
    out = io.BytesIO()
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    known, rest = by_frequency(flat)
    levels: list[tuple] = []
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(1, len(rest)) // BLOCK_BITS) * BLOCK_BITS, bool)
        padded[: len(rest)] = more
        ones = padded.reshape(-1, BLOCK_BITS).sum(1)
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)]).astype("<u8")))
        rest = rest[more] >> 8
    out.write(struct.pack("<4sIQQ", b"DAC2", len(levels), len(ids), len(flat)))
    out.write(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
    out.write(struct.pack("<Q", len(known)) + known.astype("<u4").tobytes())
    for n, chunk, bits, rank in levels:
        out.write(struct.pack("<Q", n) + chunk.tobytes() + bits.tobytes() + rank.tobytes())
    return out.getvalue()


class Packed:
    """A file's content: documents, whole or by single token."""

    def __init__(self, raw: bytes) -> None:
        magic, levels, docs, self.tokens = struct.unpack_from("<4sIQQ", raw)
        if magic != b"DAC2":
            raise ValueError("not a file of directly addressable codes")
        at = 24
        has = np.frombuffer(raw, np.uint8, docs, at)
        ids = np.frombuffer(raw, "<i8", docs, at := at + docs)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has, strict=True)]
        self.offsets = np.frombuffer(raw, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        (known,) = struct.unpack_from("<Q", raw, at := at + 8 * (docs + 1))
        self.known = np.frombuffer(raw, "<u4", known, at := at + 8).astype(np.uint32)
        at += 4 * known
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            chunk = np.frombuffer(raw, np.uint8, n, at := at + 8)
            bits = np.frombuffer(raw, np.uint8, -(-n // 8), at := at + n)
            rank = np.frombuffer(raw, "<u8", -(-max(1, n) // BLOCK_BITS) + 1, at := at + len(bits))
            at += 8 * len(rank)
            self.levels.append((n, chunk, bits, rank))

    def token(self, i: int) -> int:
        """The id at position ``i``: one chunk, one bit and one rank per level."""
        value = 0
        for k, (_, chunk, bits, rank) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            before = np.unpackbits(bits[first : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK_BITS]
            i = int(rank[block]) + int(before.sum())
        return int(self.known[value])

    def all(self) -> np.ndarray:
        """Every id of the file."""
        value: np.ndarray = np.zeros(0, np.uint32)
        for n, chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            more = np.flatnonzero(np.unpackbits(bits, count=n, bitorder="little"))
            here[more] |= value[: len(more)] << np.uint32(8)
            value = here
        return self.known[value]


class Units:
    """Ids of texts piece by piece of what the vocabulary's own splitting gives: runs of letters, single digits, runs of other
    signs, of texts in small letters. Pieces are found and looked up for a whole batch at once; a piece goes to the
    tokenizer once while it is known. Words with signs beyond ASCII and the letters of two bytes that begin with C3, with
    apostrophes, control characters or added tokens are pieces as a whole.

    Known pieces: two sorted tables of a 64-bit hash, with the place and number of their ids; beyond CACHE_UNITS those
    that were not used for the longest time go. It lives as long as the worker.
    """

    APOSTROPHE, C3 = 0x27, 0xC3
    SPACE, LETTER, DIGIT, SIGN, ODD = range(5)

    def __init__(self, tok) -> None:
        self.tok, self.model = tok, tok.model
        self.added = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        kind = np.full(256, self.ODD, np.uint8)
        kind[33:127] = self.SIGN
        kind[48:58] = self.DIGIT
        kind[65:91] = kind[97:123] = self.LETTER
        kind[[9, 10, 11, 12, 13, 32]] = self.SPACE
        kind[self.APOSTROPHE] = self.ODD
        self.kind = kind
        # the signs of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on
        other = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
        self.signs = {b: 256 + i for i, b in enumerate(other)}
        self.clock = 0
        self.keys, self.places, self.counts, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in small letters, starts and ends of all pieces, and which of them are odd words."""
        low, kind = _words.LOWER[data], self.kind[data]
        at = np.flatnonzero(data[:-1] == self.C3)
        second = data[at + 1]
        at, second = (x[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)] for x in (at, second))
        kind[at] = kind[at + 1] = self.LETTER
        low[at + 1] += np.where(second < 0x9F, 32, 0).astype(np.uint8)
        raw = data.tobytes()
        for token in self.added:
            here = raw.find(token)
            while here >= 0:
                kind[here] = self.ODD
                here = raw.find(token, here + 1)
        # a word with an odd byte is a piece
        solid = kind != self.SPACE
        border = np.zeros(len(data) + 1, bool)
        border[off] = True
        begin = solid & (np.concatenate([[True], ~solid[:-1]]) | border[:-1])
        word = np.cumsum(begin) - 1
        odd_word = np.zeros(int(begin.sum()) + 1, bool)
        odd_word[word[kind == self.ODD]] = True
        odd = odd_word[word] & solid
        kind[odd] = self.ODD
        before = np.concatenate([[self.SPACE], kind[:-1]])
        starts = np.flatnonzero(solid & ((kind != before) | (kind == self.DIGIT) | begin))
        after = np.concatenate([kind[1:], [self.SPACE]])
        last = np.concatenate([begin[1:], [True]])
        ends = np.flatnonzero(solid & ((kind != after) | (kind == self.DIGIT) | last)) + 1
        low[odd] = data[odd]
        return low, starts, ends, odd[starts]

    def _encoded(self, pieces: list[bytes], odd: list[bool]) -> list[list[int]]:
        rest = iter(self.tok.encode_batch_fast([x.decode("utf-8", "replace") for x, o in zip(pieces, odd, strict=True) if o], add_special_tokens=False))
        signs = [x.decode() if x.isascii() else x.decode("latin-1").translate(self.signs) for x in pieces]
        return [next(rest).ids if o else [t.id for t in self.model.tokenize(s)] for s, o in zip(signs, odd, strict=True)]

    def _learn(self, keys: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        """Adds pieces (with ascending keys)."""
        lists = self._encoded([low[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], odd.tolist())
        n = np.array([len(x) for x in lists], np.int64)
        flat = np.array([i for x in lists for i in x], np.uint32)
        if len(self.keys) + len(keys) > CACHE_UNITS:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE_UNITS // 2])
            kept = np.repeat(self.places[keep] - np.concatenate([[0], np.cumsum(self.counts[keep])[:-1]]), self.counts[keep]) + np.arange(self.counts[keep].sum())
            self.ids, self.keys, self.counts, self.used = self.ids[kept], self.keys[keep], self.counts[keep], self.used[keep]
            self.places = np.cumsum(self.counts) - self.counts
        to = np.searchsorted(self.keys, keys)
        self.places = np.insert(self.places, to, len(self.ids) + np.cumsum(n) - n)
        self.keys, self.counts, self.used = np.insert(self.keys, to, keys), np.insert(self.counts, to, n), np.insert(self.used, to, self.clock)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column one after the other, and the offset of each text in them."""
        data, off = _words.buffers(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        low, starts, ends, odd = self._cut(data, off)
        low = np.concatenate([low, np.zeros(8, np.uint8)])
        key = _words.spans_hash(low, starts, ends)
        key[odd] = _words.mix(key[odd] + np.uint64(1))
        unique, one, which = np.unique(key, return_index=True, return_inverse=True)
        self.clock += 1
        at = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != unique)
        if len(new):
            self._learn(unique[new], low, starts[one[new]], ends[one[new]], odd[one[new]])
            at = np.searchsorted(self.keys, unique)
            gone = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != unique)
            if len(gone):  # forgotten to make room
                self._learn(unique[gone], low, starts[one[gone]], ends[one[gone]], odd[one[gone]])
                at = np.searchsorted(self.keys, unique)
        self.used[at] = self.clock
        at = at[which]
        n = self.counts[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.places[at] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, off)]


class Encoder:
    """Ids of whole texts: by pieces where the vocabulary splits as ``Units`` does, else text by text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.units = Units(self.tok) if splits_into_units(self.tok) else None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column (null: none) one after the other, and the offset of each text in them."""
        if self.units:
            return self.units.encode(column)
        found = self.tok.encode_batch([(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()], add_special_tokens=False)
        return np.array([i for e in found for i in e.ids], np.uint32), np.concatenate([[0], np.cumsum([len(e.ids) for e in found], dtype=np.int64)])


def splits_into_units(tok) -> bool:
    """Whether a tokenizer lowers, splits and encodes as ``Units`` takes for granted, by its settings and a probe."""
    import json

    spec = json.loads(tok.to_str())
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = [(x.get("pattern") or {}).get("Regex") for x in cuts if x.get("type") == "Split" and x.get("invert") and x.get("behavior") == "Removed"]
    added = spec.get("added_tokens") or []
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or len(x["content"].split()) != 1 for x in added):
        return False
    if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or pattern != [SPLIT] or cuts[1].get("add_prefix_space"):
        return False
    text = "a  b'd\téé 1 23x\r\n(x)  It's\x0b don' t Σσ 中文  z... Éa×÷ß-Ö"
    return tok.encode(text, add_special_tokens=False).ids == Units(tok).encode(pa.array([text]))[0].tolist()


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    state = sys.modules.setdefault("_hearthline_state", types.ModuleType("_hearthline_state"))
    if getattr(state, "encoder_path", None) != path:
        state.encoder, state.encoder_path = Encoder(path), path
    return state.encoder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _writer(folder: str, name: str, end_id: int | None, file_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        release()
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        enc, end = encoder(vocabulary(name)), np.array([] if end_id is None else [end_id], np.uint32)
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        count = seq = 0

        def flush() -> pa.RecordBatch:
            # an attempt has its own file names; only files of the manifest count
            file = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{base}/{file}") as f:
                f.write(pack(docs, ids))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [file], "docs": pa.array([len(docs)], pa.int64()), "tokens": pa.array([count], pa.int64())})

        for batch in batches:
            for piece in chunks(batch, "text", 1 << 20):
                flat, off = enc.encode(piece.column(1))
                for d, a, z in zip(piece.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    docs.append(d)
                    ids.append(np.concatenate([flat[a:z], end]))
                    count += len(ids[-1])
                    if count >= file_tokens:
                        yield flush()
                        ids, docs, count, seq = [], [], 0, seq + 1
        if docs:
            yield flush()
        ids, docs = [], []
        release()

    return write


def write_tokens(docs: DataFrame, folder: str, name: str = "word_bpe_49k.json", end_id: int | None = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes ``docs`` in ascending doc_id order (null ids first) into files below ``folder``; returns their manifest.

    A file ends at the first document that brings it to ``file_tokens``. Null texts count as empty; equal doc_ids are
    documents of their own. The manifest names the files of the attempts that succeeded; others are to be ignored.
    """
    ensure_dir(folder)
    spark = docs.sparkSession
    ordered = text_only(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = ordered.mapInArrow(_writer(folder, name, end_id, file_tokens), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32 and file of every document, from the files."""
    # one row a partition of the writer, then the files of each
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).withColumn("of_parts", before(Window.orderBy("part"))).drop("tokens")
    files = manifest.withColumn("of_files", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part")
    files = files.select("path", (F.col("of_parts") + F.col("of_files")).alias("first")).repartition(min(max(1, manifest.count()), 100_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{file}") as f:
                    p = Packed(f.read())
                ids, off = p.all().astype("<u4"), p.offsets
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(p.doc_ids, pa.int64()), "start": pa.array(off[:-1] + first), "n_tokens": pa.array(np.diff(off)), "ids_crc32": pa.array(crc, pa.int64()), "file": pa.array([file] * len(crc))})

    return files.mapInArrow(read, RESULT)


def encode_to_files(docs: DataFrame, folder: str | None = None, name: str = "word_bpe_49k.json", end_id: int | None = 2) -> DataFrame:
    """Writes the ids of ``docs`` and reads the files back; an empty table gives no files and no rows. Other columns are not read."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, name, end_id), folder)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_files(table(spark, sf_dir, "documents")).drop("file")
