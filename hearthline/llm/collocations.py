"""Phrase collocations by Toivonen's sampling.

A sample of the documents proposes words and pairs of words that may be frequent. One pass over all documents counts
them and their negative border exactly: every word, every pair whose words are proposed, every triple whose pairs are.
Where a member of the border turns out frequent, the sample has failed there; it is proposed too, and a further pass
counts what that adds to the border, until no pass finds a failure. What is proposed is kept in two bitmaps of a fixed
size. A bit that is set by chance only has more phrases counted, so the results don't depend on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _words
from ._common import release, ship, small_batches, table, written

ship(__name__)

LEAST = 10  # occurrences of a phrase that is reported
SHARE, LOWERED = 8, 2  # one document of SHARE is in the sample, where LOWERED occurrences propose a phrase
BITS = 1 << 26  # of each bitmap, a power of two; as they fill up, more of the border is counted, and nothing less
PART = 1 << 15  # bits of a bitmap that come to the driver at once
CHUNK = 6 << 20  # bytes of text that a task counts at once
ROWS = 50_000  # of a batch that goes to Spark
SALTS = 64  # into which a language is split before its first phrases are chosen
U64 = np.uint64
STEP = U64(0xA24BAED4963EE407)
CUT = np.zeros(256, bool)  # bytes between pieces
CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP = CUT.copy()  # bytes between words
GAP[[9, 32]] = True
BLANK = np.zeros(256, bool)
BLANK[32] = True
COUNTED = "lang string, phrase string, words int, n long"


def _end_of_piece(data: np.ndarray, lo: int, hi: int) -> int:
    """The first place from ``lo`` on behind which a piece ends, or ``hi``."""
    while lo < hi:
        found = np.flatnonzero(CUT[data[lo : min(hi, lo + CHUNK)]])
        if len(found):
            return lo + int(found[0]) + 1
        lo += CHUNK
    return hi


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Languages and bytes of texts, about CHUNK bytes at a time; a longer text is cut between two of its pieces."""
    langs: list[str] = []
    parts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        data, off = _words.buffers(batch.column(1))
        for lang, lo, hi in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            while lo < hi:
                z = hi if hi - lo <= CHUNK else _end_of_piece(data, lo + CHUNK, hi)
                langs.append(lang)
                parts.append(data[lo:z])
                size, lo = size + z - lo, z
                if size >= CHUNK:
                    yield langs, parts
                    langs, parts, size = [], [], 0
    if parts:
        yield langs, parts


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U64)


def _spans(column: pa.Array) -> _words.Words:
    """Each entry of a binary column as one word."""
    data, off = _words.buffers(column)
    return _words.Words(data, off[:-1], off[1:], np.arange(len(off)))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _words.mix(left * STEP + right)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U64(BITS - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)


def _rows(lang: pa.Array, phrase: pa.Array, words: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(n), ROWS):
        k = min(ROWS, len(n) - i)
        yield pa.RecordBatch.from_arrays([lang.slice(i, k), phrase.slice(i, k).cast(pa.large_string()).cast(pa.string()), pa.array(np.full(k, words, np.int32)), pa.array(n[i : i + k].astype(np.int64))], ["lang", "phrase", "words", "n"])


def _counted(langs: list[str], parts: list[np.ndarray], new: tuple | None, old: tuple | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that ``new`` has in its border or proposes and ``old`` has not; without ``new``, of all words and pairs.

    The row of no words holds the number of words of a language."""
    low = _words.LOWER[np.concatenate(parts)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    w = _words.split(pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(low)]), GAP)
    if not len(w.starts):
        return
    code, names = pd.factorize(np.array(langs, object))
    text = np.repeat(np.arange(len(parts)), np.diff(w.first))
    piece = np.cumsum(CUT[low], dtype=np.int32)[w.starts]
    next_to = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    ends = np.cumsum(w.ends - w.starts)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[~GAP[low]]))]).dictionary_encode()
    del low, w
    word, size = spelled.indices.to_numpy().astype(np.int64), len(spelled.dictionary)
    key, own = pd.factorize(code[text] * size + word)  # one number for each word of each language
    v = len(own)
    lang, spelling = pa.array(names.tolist(), pa.string()).take(pa.array(own // size)), spelled.dictionary.take(pa.array(own % size))
    counts = np.bincount(key, minlength=v)
    if old is None:
        yield from _rows(lang, spelling, 1, counts)
        total = np.bincount(own // size, counts, len(names)).astype(np.int64)
        yield from _rows(pa.array(names.tolist(), pa.string()), pa.array([b""] * len(names), pa.large_binary()), 0, total)
    h = _words.mix(_words.hashes(_spans(spelling)) ^ _lang_hashes(names.tolist())[own // size])
    at = np.flatnonzero(next_to)
    pairs = at
    if new is not None:
        in_new = _has(new[0], h)
        pairs = pairs[in_new[key[pairs]] & in_new[key[pairs + 1]]]
    if old is not None:
        in_old = _has(old[0], h)
        pairs = pairs[~(in_old[key[pairs]] & in_old[key[pairs + 1]])]
    found, n = np.unique(key[pairs] * v + key[pairs + 1], return_counts=True)
    yield from _rows(lang.take(pa.array(found // v)), pc.binary_join_element_wise(spelling.take(pa.array(found // v)), spelling.take(pa.array(found % v)), pa.scalar(b" ", pa.large_binary())), 2, n)
    if new is None:
        return
    hp = _pair(h[key[at]], h[key[at + 1]])
    proposed = np.zeros(len(key), bool)
    proposed[at] = _has(new[1], hp)
    triples = np.flatnonzero(proposed[:-1] & proposed[1:])
    if old is not None:
        proposed[:] = False
        proposed[at] = _has(old[1], hp)
        triples = triples[~(proposed[triples] & proposed[triples + 1])]
    heads, head = np.unique(key[triples] * v + key[triples + 1], return_inverse=True)
    found, n = np.unique(head * v + key[triples + 2], return_counts=True)
    x, z = heads[found // v], found % v
    take = lambda i: spelling.take(pa.array(i))
    yield from _rows(lang.take(pa.array(z)), pc.binary_join_element_wise(take(x // v), take(x % v), take(z), pa.scalar(b" ", pa.large_binary())), 3, n)


def _counter(new: tuple | None, old: tuple | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, parts in _parts(batches):
            yield from _counted(langs, parts, new, old)
        release()

    return rows


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (words, h) of the words and pairs among rows (lang, phrase, words)."""
    for batch in batches:
        batch = batch.filter(pc.is_in(batch.column(2), pa.array([1, 2], pa.int32())))
        if not len(batch):
            continue
        code, names = pd.factorize(np.array(batch.column(0).to_pylist(), object))
        w = _words.split(batch.column(1), BLANK)
        h = _words.mix(_words.hashes(w) ^ _lang_hashes(names.tolist())[np.repeat(code, np.diff(w.first))])
        two = np.diff(w.first) == 2
        out = h[w.first[:-1]]
        out[two] = _pair(out[two], h[w.first[:-1][two] + 1])
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out.view(np.int64))], ["words", "h"])


def _proposed(phrases: DataFrame, before: tuple | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Both bitmaps with the words and pairs of ``phrases`` in them; None where ``before`` has them all.

    What comes to the driver is bounded by the size of the bitmaps."""
    at = F.col("h").bitwiseAND(F.lit(BITS - 1))
    found = phrases.select("lang", "phrase", "words").mapInArrow(_hashed, "words int, h long").withColumn("at", at)
    bits = found.groupBy("words", F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(PART - 1))).alias("bits"))
    out = [np.zeros(BITS // 64, U64) if before is None else before[k].copy() for k in (0, 1)]
    more = False
    for row in bits.toLocalIterator():  # parts of PART bits
        own = out[row["words"] - 1][row["part"] * PART // 64 :][: PART // 64]
        add = np.frombuffer(row["bits"], "<u8")[: len(own)]
        more |= bool((add & ~own).any())
        own |= add
    return (out[0], out[1]) if more or before is None else None


def _count(docs: DataFrame, new: tuple | None, old: tuple | None, least: int) -> DataFrame:
    """lang, phrase, words and n of what a pass counts at least ``least`` times, and the words of each language."""
    held = docs.sparkSession.sparkContext.broadcast((new, old))
    counts = docs.mapInArrow(lambda b: _counter(*held.value)(b), COUNTED).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return written(counts.filter((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, lowered: int = LOWERED) -> tuple[DataFrame, int]:
    """lang, phrase, words (1 to 3; 0: all words of the language) and n, exact, of all phrases with ``least`` occurrences, and the
    number of passes over all documents that closed the border."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    sample = _count(texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0), None, None, lowered)
    old, new, all_counts, passes = None, _proposed(sample, None), None, 0
    while new is not None:
        found = _count(texts, new, old, least)
        all_counts = found if all_counts is None else all_counts.unionByName(found)
        passes += 1
        old, new = new, _proposed(found, new)
    return all_counts, passes


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of every candidate; contained: whether a longer candidate makes it superfluous."""
    f = counts.filter("words > 0").select("lang", "phrase", "words", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    at = lambda *i: F.concat_ws(" ", *(word[k] for k in i))
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = F.when(F.col("words") == 2, F.array(cut(1, at(0), at(1)))).otherwise(F.array(cut(1, at(0), at(1, 2)), cut(2, at(0, 1), at(2))))
    c = f.filter("words > 1").withColumn("cut", F.explode(cuts)).select("lang", "phrase", "words", "a", "cut.*")
    c = c.join(f.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    wide = "CAST({} AS DECIMAL(38,0))".format  # products pass 64 bits
    c = c.withColumn("score", F.expr(f"({wide(1_000_000)} * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    best = c.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = f.filter("words = 3").select("lang", "a", F.explode(F.array(at(0, 1), at(1, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return best.join(longer, ["lang", "phrase"], "left").select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score", F.coalesce(100 * F.col("longer") >= 50 * F.col("a"), F.lit(False)).alias("contained"))


def collocations(docs: DataFrame, most: int = 2000, **options) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Null and empty texts have no words; a null lang is ``und``. Repeated rows count as often as they stand there; ties are
    settled by the phrase. No other columns are read. A very long text is counted in parts that end between two pieces. An
    empty table, or one without a phrase of ten occurrences, gives no rows.
    """
    counts, _ = phrases(docs, **options)
    c = scored(counts).filter("NOT contained").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    totals = counts.filter("words = 0").select("lang", "n")
    return c.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
p AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, words, count(*)::BIGINT AS a FROM p GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE words > 1),
cuts AS (SELECT lang, phrase, words, a, k, array_to_string(x[1:k], ' ') AS lft, array_to_string(x[k + 1:words], ' ') AS rgt FROM s, (VALUES (1), (2)) AS v(k) WHERE k < words),
c AS (SELECT cuts.*, l.a AS l, r.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (l.a::HUGEINT * r.a) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lft JOIN f r ON r.lang = cuts.lang AND r.phrase = rgt),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS phrase, a FROM s WHERE words = 3),
gone AS (SELECT DISTINCT best.lang, best.phrase FROM best JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase AND 100 * longer.a >= 50 * best.a),
kept AS (SELECT * FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
