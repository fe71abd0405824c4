"""Benchmark decontamination: rare n-gram seeds bring passages and test items together, alignment scores them.

An item's seeds are its n-grams of words that are rarest in the corpus. Where a document holds seeds, the passage around
them is cut out and joined to the items of its seeds; Smith-Waterman alignment over words then scores the pair, so that
edited or paraphrased copies count as well as exact ones. Seeds that are too frequent for this join are looked up where
the texts are: a pair is aligned there if enough of the item's words stand around a hit to reach the least score.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _words
from ._common import ship, table, text_only, written
from ._words import chunks

ship(__name__)

SEED = 3  # words
RARE, MOST = 20, 1000  # documents: seeds in no more than the first count as rare, whatever the item's others, and in more than the second never
LONG = 8  # passages are no longer than so many times what may stand around a hit, and two of these
LEAST = 0.4  # of the score that an exact copy of the item has
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_SEEDS = 1_000_000  # seeds that a task holds at once; a larger benchmark is taken in blocks
SLICE = 1 << 18  # pairs of a hit and an item that a task looks at at once
FOUND = "doc_id long, tag long, at int, words array<long>, seeds array<struct<seed:long,place:int>>"
ALIGNED = "doc_id long, tag long, item_id long, seeds int, score double, first_word long, last_word long"


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = _words.split(batch.column(1), _words.NOT_ALNUM)
        h = _words.hashes(w, lower=True).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(h))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "words"])


def _seeds(h: np.ndarray) -> np.ndarray:
    return _words.runs(h, SEED).view(np.int64)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = _seeds(np.array(words, np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(s), pa.int64()), pa.array(s), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(np.full(len(s), len(words), np.int32))], ["item_id", "seed", "item_at", "size"])


def _pad(size, least: float):
    """Words that an alignment of at least ``least`` may have beside an item of ``size`` words: 2 a match, 1 off a word left out, so
    that with more words between the score falls below the least."""
    return np.ceil(MATCH * np.asarray(size) * max(0.0, 1 - least) / -GAP).astype(np.int64) + 1


def _hits(piece: pa.RecordBatch, wanted: np.ndarray) -> tuple[_words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words and hashes of a piece, the places of the wanted seeds in it, and the text of each."""
    w = _words.split(piece.column(1), _words.NOT_ALNUM)
    h = _words.hashes(w, lower=True)
    s = _seeds(h)
    at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)] == s) if len(wanted) else np.zeros(0, np.int64)
    text = np.searchsorted(w.first, at, "right") - 1
    inside = at + SEED <= w.first[text + 1]
    return w, h, at[inside], text[inside]


def _count(held):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                _, h, at, text = _hits(piece, held.value)
                pairs = np.unique(np.stack([_seeds(h)[at], text]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                seed, n = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(n)], ["seed", "df"])

    return rows


def _passages(held):
    """The passages around the hits of seeds; each seed reaches as far as the longest item that has it may need, others don't matter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, reaches = held.value
        for batch in batches:
            for piece in chunks(batch, "text"):
                w, h, at, text = _hits(piece, wanted)
                if not len(at):
                    continue
                h, s = h.view(np.int64), _seeds(h)
                reach = reaches[np.searchsorted(wanted, s[at])]
                cut = np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] > np.maximum.accumulate(np.minimum(at + reach, w.first[text + 1]))[:-1])])
                # long chains of hits are cut: what an alignment through a hit can reach is in its passage all the same
                begin, chain = np.flatnonzero(cut), np.cumsum(cut) - 1
                step = (at - at[begin][chain]) // (LONG * np.maximum.reduceat(reach, begin)[chain])
                cut[1:] |= step[1:] != step[:-1]
                begin = np.flatnonzero(cut)
                last = np.append(begin[1:], len(at)) - 1
                t = text[begin]
                a, z = np.maximum(w.first[t], np.minimum.reduceat(at - reach, begin)), np.minimum(w.first[t + 1], np.maximum.reduceat(at + SEED + reach, begin))
                words = [h[x:y] for x, y in zip(a, z, strict=True)]
                seeds = [[{"seed": int(s[p]), "place": int(p - x)} for p in at[b : e + 1]] for b, e, x in zip(begin, last, a, strict=True)]
                kind = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(t)), piece.column(2).take(pa.array(t)), pa.array((a - w.first[t]).astype(np.int32)), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, kind)], ["doc_id", "tag", "at", "words", "seeds"])

    return rows


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ranges that begin at ``first`` with ``n`` places each, and the number of the range of each place."""
    of = np.repeat(np.arange(len(n)), n)
    return first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of


def _looked_up(seeds: pd.DataFrame, items: pd.DataFrame) -> SimpleNamespace:
    """Seeds with the items and places that have them, and the words of these items, as arrays."""
    ids = items["item_id"].to_numpy(np.int64)
    words = np.concatenate([np.asarray(w, np.int64) for w in items["words"]])
    vocabulary, numbers = np.unique(words, return_inverse=True)
    order = np.argsort(seeds["seed"].to_numpy(np.int64), kind="stable")
    seed, start = np.unique(seeds["seed"].to_numpy(np.int64)[order], return_index=True)
    by_id = np.argsort(ids)
    item = by_id[np.searchsorted(ids[by_id], seeds["item_id"].to_numpy(np.int64)[order])]
    first = np.concatenate([[0], np.cumsum([len(w) for w in items["words"]])])
    return SimpleNamespace(item_ids=ids, first=first, words=words, vocabulary=vocabulary, numbers=numbers, seeds=seed, start=np.append(start, len(order)), item=item, place=seeds["item_at"].to_numpy(np.int64)[order])


def _regions(held: SimpleNamespace, w: _words.Words, at: np.ndarray, text: np.ndarray, which: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """text, item, hits, begin and end of the regions in which an alignment through a hit can lie."""
    pos, of = _spread(held.start[which], held.start[which + 1] - held.start[which])
    t, item, begin = text[of], held.item[pos], at[of] - held.place[pos]
    order = np.lexsort((begin, item, t))
    t, item, begin = t[order], item[order], begin[order]
    size = held.first[item + 1] - held.first[item]
    pad = _pad(size, least)
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + size[1:])])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(t)) - 1
    low, high = w.first[t[a]], w.first[t[a] + 1]
    return t[a], item[a], z - a + 1, np.maximum(low, begin[a] - pad[a]), np.minimum(high, begin[z] + size[a] + pad[a])


def _frequent(shared, least: float):
    """The alignments of at least ``least`` through the hits of frequent seeds, found within the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for piece in chunks(batch, "text"):
                w, h, at, text = _hits(piece, held.seeds)
                if not len(at):
                    continue
                which = np.searchsorted(held.seeds, _seeds(h)[at])
                h = h.view(np.int64)
                no = np.minimum(np.searchsorted(held.vocabulary, h), len(held.vocabulary) - 1)
                known = np.flatnonzero(held.vocabulary[no] == h)
                index = np.sort(no[known] * (len(h) + 1) + known)  # where each word of the items stands
                ends = np.cumsum(held.start[which + 1] - held.start[which])
                lo = 0
                while lo < len(at):  # a slice ends between texts, if it can
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, "right")))
                    if hi < len(at) and text[hi] != text[lo]:
                        hi = int(np.searchsorted(text, text[hi]))
                    t, item, hits, begin, end = _regions(held, w, at[lo:hi], text[lo:hi], which[lo:hi], least)
                    lo = hi
                    out: list[tuple] = []
                    size = held.first[item + 1] - held.first[item]
                    parts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), SLICE), "left")
                    for x, y in zip(parts, [*parts[1:], len(t)], strict=True):
                        place, of = _spread(held.first[item[x:y]], size[x:y])
                        key = held.numbers[place] * (len(h) + 1)
                        there = np.searchsorted(index, key + begin[x:y][of]) < np.searchsorted(index, key + end[x:y][of])
                        good = x + np.flatnonzero(np.bincount(of[there], minlength=y - x) >= least * size[x:y] - 1e-9)
                        for i in good:
                            score, p, q = align(held.words[held.first[item[i]] : held.first[item[i] + 1]], h[begin[i] : end[i]])
                            if (score := score / (MATCH * int(size[i]))) >= least:
                                a = int(begin[i] - w.first[t[i]])
                                out.append((int(t[i]), int(held.item_ids[item[i]]), int(hits[i]), score, a + p, a + q))
                    if out:
                        c = list(zip(*out, strict=True))
                        take = pa.array(c[0])
                        yield pa.RecordBatch.from_arrays([piece.column(0).take(take), piece.column(2).take(take), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64())], ["doc_id", "tag", "item_id", "seeds", "score", "first_word", "last_word"])

    return rows


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and the words of the passage from and to which it reaches."""
    n = len(passage)
    ramp = -GAP * np.arange(1, n + 1)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for x in item:
        diagonal = row[:-1] + np.where(passage == x, MATCH, MISMATCH)
        above = row[1:] + GAP
        up = above > diagonal
        value, start = np.where(up, above, diagonal), np.where(up, origin[1:], origin[:-1])
        fresh = value <= 0
        value, start = np.where(fresh, 0, value), np.where(fresh, np.arange(1, n + 1), start)
        raised = value + ramp  # a gap to the right costs as much for each word
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, np.arange(n), 0))
        value, start = top - ramp, start[source]
        row, origin = np.concatenate([[0], value]), np.concatenate([[0], start])
        j = int(value.argmax()) if n else 0
        if n and value[j] > best[0]:
            best = (int(value[j]), int(start[j]), j + 1)
    return best


def _aligned(least: float):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for item, words, low, high in zip(f["item"], f["words"], f["low"], f["high"], strict=True):
                pad = int(_pad(len(item), least))
                a, z = max(0, low - pad), min(len(words), high + len(item) + pad)
                score, x, y = align(item, words[a:z])
                out.append((score / (MATCH * len(item)), a + x, a + y))
            score, x, y = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
            yield pd.DataFrame({"doc_id": f["doc_id"], "tag": f["tag"], "item_id": f["item_id"], "seeds": f["hits"], "score": np.array(score, float), "first_word": f["at"] + np.array(x, np.int64), "last_word": f["at"] + np.array(y, np.int64)})

    return rows


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, tag (hash of the text), item_id, seeds, score, first_word, last_word (exclusive) of every document and item
    whose alignment scores ``least`` or more of the item's full score; the best passage of each pair.

    Words are runs of letters and digits, in any case. Null and empty texts match nothing; items of fewer than SEED words
    have no seed and match nothing. Equal items and equal documents match alike, and of rows equal in doc_id and text one
    counts. Very long texts are taken in passages around the hits. Other columns are not read. An empty table gives no rows.

    Seeds in up to MOST documents join passages to items; more frequent ones never shuffle, whatever share of the rows has
    them: they are looked up and aligned where the texts are.
    """
    docs = text_only(docs).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_words, "item_id long, words array<long>")
    items = written(items.filter(F.size("words") >= SEED), "items")
    seeds = written(items.mapInArrow(_item_seeds, "item_id long, seed long, item_at int, size int"), "seeds")
    total = seeds.count()
    found = [_block(docs, items, seeds.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), least) for blocks in [max(1, -(-total // BLOCK_SEEDS))] for b in range(blocks)]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    place = F.row_number().over(Window.partitionBy("doc_id", "tag", "item_id").orderBy(F.desc("score"), "first_word"))
    return every.filter(F.col("score") >= least).withColumn("__place", place).filter("__place = 1").drop("__place")


def _block(docs: DataFrame, items: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """The same for the items of these seeds, of which there are BLOCK_SEEDS or little more."""
    sc = docs.sparkSession.sparkContext
    held = lambda s: sc.broadcast(np.sort(s.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64)))
    df = docs.mapInArrow(_count(held(seeds)), "seed long, df long").groupBy("seed").agg(F.sum("df").alias("df"))
    middle = F.percentile("df", F.lit(0.5)).over(Window.partitionBy("item_id"))
    rare = seeds.join(df, "seed", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    told = written(rare.filter("df > 0").withColumn("rare", F.col("df") <= F.greatest(F.least(middle, F.lit(MOST)), F.lit(RARE))), "told")
    rare, frequent = told.filter("rare").drop("rare"), told.filter("NOT rare")
    reach = rare.groupBy("seed").agg(F.max("size").alias("size")).toPandas().sort_values("seed")
    reach = sc.broadcast((reach["seed"].to_numpy(np.int64), reach["size"].to_numpy(np.int64) + _pad(reach["size"], least)))
    passages = written(docs.mapInArrow(_passages(reach), FOUND), "passages")
    place = passages.select("doc_id", "tag", "at", F.explode("seeds").alias("s")).select("doc_id", "tag", "at", "s.seed", "s.place")
    pairs = place.join(rare, "seed").groupBy("doc_id", "tag", "at", "item_id").agg(F.min(F.col("place") - F.col("item_at")).alias("low"), F.max(F.col("place") - F.col("item_at")).alias("high"), F.count(F.lit(1)).cast("int").alias("hits"))
    keyed = lambda d: d.withColumn("__id", F.coalesce("doc_id", F.lit(-(1 << 63)))).drop("doc_id")
    both = keyed(pairs).join(keyed(passages.drop("seeds")), ["__id", "tag", "at"]).join(items.withColumnRenamed("words", "item"), "item_id")
    both = both.withColumn("doc_id", F.nullif("__id", F.lit(-(1 << 63))))
    by_rare = both.select("doc_id", "tag", "at", "item_id", "low", "high", "hits", "words", "item").mapInPandas(_aligned(least), ALIGNED)
    left = frequent.select("item_id", "seed", "item_at").toPandas()
    if not len(left):
        return by_rare
    own = items.join(frequent.select("item_id").distinct(), "item_id", "left_semi").toPandas()
    return by_rare.unionByName(docs.mapInArrow(_frequent(sc.broadcast(_looked_up(left, own)), least), ALIGNED))


def without(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""
    hit = matches(docs, benchmark, least).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("tag").alias("__tag")).distinct()
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    # an anti join on expressions adds no column to ``docs``, so none of its own can clash
    return docs.join(hit, (own == hit["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["__tag"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")
