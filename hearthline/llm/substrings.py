"""Substring deduplication by super-k-mers of words.

A window is WINDOW consecutive words of a document; its minimiser is the least of its word m-mers in a fixed order in
which m-mers that are frequent in the corpus come last. Consecutive windows with one minimiser travel as one packed
string to the minimiser's bucket, where sorting brings equal windows together and shows which of them starts first.
Windows whose minimiser occurs once in the corpus cannot repeat and stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import release, ship, table, text_only, written
from ._words import chunks

ship(__name__)

WINDOW, MER = 20, 4
BITS = 1 << 25  # of the filter of repeated minimisers; when it fills up, more windows travel, and none fewer
PART = 4 << 20  # bytes of super-k-mers that are sorted at once
SEEN = 100_000  # strings that a task remembers to have sent
FREQUENT = 20_000  # m-mers that come last in the order, at most
U64 = np.uint64
TOP = U64(1 << 63)
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id, which comes before all others


def _least(o: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, x = 1, o
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(o) - width + 1], x[width - have : len(o) - have + 1]) if width > have else x


def _windows(w: _words.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """m-mers (63 bits) and the starts of the windows that lie inside a text."""
    n = np.diff(w.first)
    starts = np.arange(len(h))[np.repeat(w.first[1:] - WINDOW, n) >= np.arange(len(h))] if len(h) else np.zeros(0, np.int64)
    return _words.runs(h, MER) >> U64(1), starts


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mer, places): how often an m-mer is the minimiser of some window, by place."""
    width = WINDOW - MER + 1
    for batch in batches:
        for piece in chunks(batch, "text"):
            w = _words.split(piece.column(0))
            o, starts = _windows(w, _words.hashes(w))
            if not len(starts):
                continue
            p = _least(o, width)[starts]
            chosen = np.zeros(len(o), bool)
            for i in range(width):
                chosen[starts + i] |= o[starts + i] == p
            mer, places = np.unique(o[chosen], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mer.view(np.int64)), pa.array(places)], ["mer", "places"])


def repeated(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent m-mers (sorted, FREQUENT at most) and a bitmap of BITS bits with the minimisers that occur more than once.

    Both have a fixed bound, whatever the corpus; all counts are made over all of it."""
    counts = written(docs.select("text").mapInArrow(_minimisers, "mer long, places long").groupBy("mer").agg(F.sum("places").alias("places")).filter("places > 1"), "minimisers")
    total = counts.agg(F.sum("places")).first()[0] or 0
    frequent = counts.filter(F.col("places") > max(1000, total // FREQUENT)).select("mer").toPandas()["mer"].to_numpy(np.int64).view(U64)
    bit = F.pmod("mer", F.lit(BITS))
    words = counts.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("mer", F.lit(64)).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return np.sort(frequent), bitmap.view(U64)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _super_mers(frequent: np.ndarray, bitmap: np.ndarray):
    """Rows (key, doc_id, tag, at, n, packed): n words from ``at`` on; without ``packed``, words that are known to go.

    Of equal strings in a task the one that starts first travels, as far as they are known when it goes; later ones repeat
    all its windows, so all their words go and they travel without their words. So a passage that stands in any share of
    the documents reaches its bucket about once a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for piece in chunks(batch, "text"):
                yield from _of_piece(piece, frequent, bitmap, sent)
                if len(sent) > SEEN:
                    sent.clear()

    return rows


def _of_piece(piece: pa.RecordBatch, frequent: np.ndarray, bitmap: np.ndarray, sent: dict[bytes, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    w = _words.split(piece.column(1))
    o, starts = _windows(w, _words.hashes(w))
    if not len(starts):
        return
    plain = _least(o, WINDOW - MER + 1)[starts]
    travels = (bitmap[(plain % U64(BITS) >> U64(6)).astype(np.int64)] >> (plain & U64(63)) & U64(1)).astype(bool)
    starts = starts[travels]
    if not len(starts):
        return
    key = _least(np.where(_in(o, frequent), o | TOP, o), WINDOW - MER + 1)[starts]
    text = np.searchsorted(w.first, starts, "right") - 1
    cut = np.concatenate([[True], (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(cut)
    last = np.append(begin[1:], len(starts)) - 1
    doc = piece.column(0).fill_null(NO_ID).to_numpy()[text[begin]]
    tag = piece.column(2).fill_null(0).to_numpy()[text[begin]]
    at, n = starts[begin] - w.first[text[begin]], starts[last] - starts[begin] + WINDOW
    raw, a, z = w.data.tobytes(), w.starts[starts[begin]].tolist(), w.ends[starts[last] + WINDOW - 1].tolist()
    packed = [b" ".join(raw[x:y].split()) for x, y in zip(a, z, strict=True)]
    stays = np.ones(len(packed), bool)
    for i in np.lexsort((at, doc)).tolist():
        own = (int(doc[i]), int(at[i]))
        before = sent.get(packed[i])
        if before is None or own < before:
            sent[packed[i]] = own
        elif own > before:  # equal rows of one doc_id: neither starts before the other
            stays[i] = False
    to = np.where(stays, key[begin], _words.mix(doc.view(U64) + at.view(U64))).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(doc), pa.array(tag), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array([p if s else None for p, s in zip(packed, stays, strict=True)], pa.binary())], ["key", "doc", "tag", "at", "n", "packed"])


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tag, a, z): words a to z of a document that a window covers which starts earlier too.

    Rows come in order of key, string and start: of equal strings only the first is kept, so that what is held at a time is
    PART bytes and the distinct strings of one key."""
    held: list[tuple] = []
    size, last, word, first = 0, None, None, (0, 0)
    for batch in batches:
        gone: list[tuple] = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            key, doc, tag, at, n, packed = row
            if packed is None or key == last and packed == word and (doc, at) > first:
                gone.append((doc, tag, at, at + n))
                continue
            if key != last and size > PART:
                yield from _sorted_windows(held)
                held, size = [], 0
            last, word, first = key, packed, (doc, at)
            held.append(row[1:])
            size += len(packed)
        if gone:
            yield _spans(*zip(*gone, strict=True))
    if held:
        yield from _sorted_windows(held)
    del held
    release()


def _spans(doc, tag, a, z) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], ["doc", "tag", "a", "z"])


def _sorted_windows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    doc, tag, at, _, packed = zip(*rows, strict=True)
    doc, tag, at = np.array(doc, np.int64), np.array(tag, np.int64), np.array(at, np.int64)
    w = _words.split(pa.array(packed, pa.binary()))
    h = _words.hashes(w)
    n = np.diff(w.first)
    starts = np.arange(len(h))[np.repeat(w.first[1:] - WINDOW, n) >= np.arange(len(h))]
    x = _words.runs(h, WINDOW)[starts]
    order = np.argsort(x, kind="stable")
    again = x[order][1:] == x[order][:-1]
    starts = np.sort(starts[order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]])  # equal windows have equal hashes
    if not len(starts):
        return
    row = np.searchsorted(w.first, starts, "right") - 1
    raw, place = w.data.tobytes(), at[row] + starts - w.first[row]
    spans = zip(w.starts[starts].tolist(), w.ends[starts + WINDOW - 1].tolist(), strict=True)
    windows = [raw[a:z] for a, z in spans]
    gone = np.zeros(len(starts), bool)
    before: bytes | None = None
    owner = (0, 0)
    docs, places = doc[row].tolist(), place.tolist()
    for i in sorted(range(len(windows)), key=lambda i: (windows[i], docs[i], places[i])):
        if windows[i] != before:
            before, owner = windows[i], (docs[i], places[i])
        else:
            gone[i] = (docs[i], places[i]) > owner
    row, place = row[gone], place[gone]
    if not len(row):
        return
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
    last = np.append(cut[1:], len(row)) - 1
    yield _spans(doc[row[cut]], tag[row[cut]], place[cut], place[last] + WINDOW)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, tag, spans): per document (and hash of its text) the word spans of windows that start earlier too."""
    frequent, bitmap = repeated(docs)
    held = docs.sparkSession.sparkContext.broadcast((frequent, bitmap))
    sent = docs.mapInArrow(lambda b: _super_mers(*held.value)(b), "key long, doc long, tag long, at int, n int, packed binary")
    spans = sent.repartition("key").sortWithinPartitions("key", "packed", "doc", "at").mapInArrow(_bucket, "doc long, tag long, a int, z int")
    return spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        spans = batch.column(2)
        out: tuple[list, ...] = ([], [], [], [])
        for i in range(len(batch)):
            words = (texts[i].as_py() or b"").split()
            stay = np.ones(len(words), bool)
            for s in spans[i].as_py() or ():
                stay[s["a"] : s["z"]] = False
            kept = words if stay.all() else [x for x, k in zip(words, stay.tolist(), strict=True) if k]
            joined = b" ".join(kept)
            for c, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space) of each document.

    Removed is every word that a window covers whose words also start earlier (smaller doc_id, or earlier in the same
    document). Documents below WINDOW words keep all; null and empty texts have none. A null doc_id comes first in order. Rows
    of one doc_id do not come before each other, so equal rows fare alike. Very long texts are taken whole. Other columns are
    not read. An empty table gives no rows.
    """
    docs = text_only(docs).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    r = repeats(docs)
    own = F.coalesce("doc_id", F.lit(NO_ID))
    joined = docs.withColumn("doc", own).join(r, ["doc", "tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
