"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles. Equal sets are one class. Of each class the shingles that come first in a global
order are counted over the corpus; a class of which too few occur elsewhere cannot have a partner. What is left meets
in groups: two similar sets share a rare shingle, and go to the group of the first set that holds it. A task searches
its groups with DivideSkip: the short inverted lists of a query are merged, the long ones probed by bisection, and
candidates that reach the required overlap are linked. Lists that hold only sets linked to the query already can't add
a link between classes that are still apart, and are left out, so that a large group of near copies costs a search of
few lists for each set.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import discarded, release, ship, table, text_only, written
from ._words import chunks
from .components import components

ship(__name__)

WIDTH = 5
EXTRA = 64  # shingles beyond the least prefix that are counted, so many of which a partner must share
SKIP = 0.01  # DivideSkip's mu: how soon lists count as long
MERGE = 512  # entries up to which lists are merged by a heap, beyond that by a sort of their runs
GROUP_ITEMS = 500_000  # of a chunk; a larger group is dealt as pairs of chunks
TASK_ITEMS = 1_000_000  # that a task of the search is to have
BROADCAST_ROWS = 2_000_000
U64 = np.uint64


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct shingles; a shorter text is one shingle, one without words none."""
    w = _words.split(column)
    h = _words.hashes(w, lower=True)
    r = _words.runs(h, width).view(np.int64)
    out = []
    for a, z in zip(w.first[:-1], w.first[1:], strict=True):
        out.append(np.unique(r[a : z - width + 1]) if z - a >= width else _words.runs(h[a:z], z - a).view(np.int64) if z > a else r[:0])
    return out


def signature(s: np.ndarray) -> int:
    """A hash of a set of hashes; 0 only for the empty set."""
    if not len(s):
        return 0
    x = _words.mix(np.array([_words.mix(s.view(U64)).sum(), len(s)], U64))
    return int((x[0] ^ (x[1] >> U64(1))).view(np.int64)) or 1


def required(n: int) -> int:
    """Shingles that a set of n shares with any partner at least."""
    return -(-4 * n // 5)


def least_shared(n: int) -> int:
    """Shingles counted of a set of n that occur in a partner's counted ones at least (the partner has 0.8 n or more)."""
    return min(EXTRA, required(required(n)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks(batch, "text"):
            sets = shingle_sets(piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64())], ["doc_id", "n", "sig"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sig, credit, n). credit -1: the shingle ``key`` is in class ``sig``; sig 0: it is in several classes of
    this piece, which have their credit for it already. Else: what class ``sig`` of n shingles is credited so far."""
    for batch in batches:
        for piece in chunks(batch, "text"):
            by_sig = {signature(s): s for s in shingle_sets(piece.column(1)) if len(s)}
            if not by_sig:
                continue
            sigs = np.array(list(by_sig), np.int64)
            n = np.array([len(s) for s in by_sig.values()], np.int64)
            heads = [s[: len(s) - required(len(s)) + min(EXTRA, required(len(s)))] for s in by_sig.values()]
            key, owner = np.concatenate(heads), np.repeat(np.arange(len(sigs)), [len(x) for x in heads])
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            known = np.bincount(owner[several], minlength=len(sigs))
            one, many = ~several, several & new
            k = np.concatenate([key[one], key[many], _words.mix(sigs.view(U64)).view(np.int64)])
            s = np.concatenate([sigs[owner[one]], np.zeros(many.sum(), np.int64), sigs])
            c = np.concatenate([np.full(one.sum() + many.sum(), -1), known]).astype(np.int32)
            m = np.concatenate([np.zeros(one.sum() + many.sum(), np.int64), n]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s), pa.array(c), pa.array(m)], ["key", "sig", "credit", "n"])


def _credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, credit, n): a credit for every counted shingle of a class that another class has too."""
    keys, sigs = [], []
    for batch in batches:
        key, sig, credit, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        own = credit >= 0
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[own]), pa.array(credit[own].astype(np.int64)), pa.array(n[own].astype(np.int64))], ["sig", "credit", "n"])
        keys.append(key[~own])
        sigs.append(sig[~own])
    if not keys:
        return
    key, sig = np.concatenate(keys), np.concatenate(sigs)
    order = np.lexsort((sig, key))
    key, sig = key[order], sig[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])[: len(key)]
    key, sig = key[fresh], sig[fresh]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    group = np.cumsum(new) - 1
    shared = ((np.bincount(group) > 1) | (np.bincount(group, sig == 0) > 0))[group] if len(group) else new
    found, times = np.unique(sig[shared & (sig != 0)], return_counts=True)
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64)), pa.array(np.zeros(len(found), np.int64))], ["sig", "credit", "n"])


def _items_of(wanted: np.ndarray | None):
    """Rows (sig, item, n) of whole sets, of the documents in ``wanted`` (sorted) if given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                d = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
                at = np.minimum(np.searchsorted(wanted, d), max(0, len(wanted) - 1))
                batch = batch.filter(pa.array(wanted[at] == d if len(wanted) else np.zeros(len(d), bool)))
            for piece in chunks(batch, "text"):
                sets = [s for s in shingle_sets(piece.column(1)) if len(s)]
                if sets:
                    n = [len(s) for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([signature(s) for s in sets], n)), pa.array(np.concatenate(sets)), pa.array(np.repeat(n, n).astype(np.int32))], ["sig", "item", "n"])

    return rows


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, item, n) of the document doc_id of each of ``classes``; their ids are broadcast up to BROADCAST_ROWS, else joined."""
    ids = classes.select("doc_id").filter("doc_id IS NOT NULL")
    if ids.count() <= BROADCAST_ROWS:
        held = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64)))
        return docs.mapInArrow(lambda b: _items_of(held.value)(b), "sig long, item long, n int")
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(_items_of(None), "sig long, item long, n int")


class Index:
    """Inverted lists over sets in ascending order of size, and which of the sets are connected so far.

    ``sets`` are arrays of distinct items, ``n`` the sizes of the whole sets (items that no other set has may be left out)."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray) -> None:
        self.n, m = n, len(sets)
        self.first = np.cumsum([0, *map(len, sets)])
        _, item = np.unique(np.concatenate(sets) if m else np.zeros(0, np.int64), return_inverse=True)
        order = np.argsort(item, kind="stable")
        self.post = np.repeat(np.arange(m), np.diff(self.first))[order]  # all lists, one after the other
        self.keys = item[order] * m + self.post  # ascending: a list is probed by bisection
        self.item = item
        self.start = np.searchsorted(item[order], np.arange(item.max() + 1 if len(item) else 0))
        self.at = np.empty(len(item), np.int64)  # of each item of each set, its place in its list
        self.at[order] = np.arange(len(item))
        earlier = self.at - self.start[item]
        held = np.concatenate([[0], np.cumsum(earlier > 0)])
        self.hopeful = held[self.first[1:]] - held[self.first[:-1]] >= -(-4 * n // 5)
        self.label = np.arange(m)
        self.members = {}  # of labels that hold several sets
        self.mixed = np.zeros(len(self.start), bool)  # lists with sets of several labels

    def union(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        x, y = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(x) > len(y):
            a, x, y = b, y, x
        keep = int(self.label[y[0]])
        self.label[x] = keep
        y.extend(x)
        self.members[keep] = y

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs with a Jaccard similarity of 0.8 or more that connect all sets which such pairs connect."""
        for i, hopeful in enumerate(self.hopeful.tolist()):
            item = self.item[self.first[i] : self.first[i + 1]]
            start, end = self.start[item], self.at[self.first[i] : self.first[i + 1]]
            some = end > start
            start, end, item = start[some], end[some], item[some]
            if hopeful:
                yield from self._search(i, item, start, end)
            self.mixed[item] |= self.label[self.post[start]] != self.label[i]

    def _search(self, i: int, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
        n, least = int(self.n[i]), required(int(self.n[i]))
        # the set that is last in most of the lists often is a partner by itself
        last, times = np.unique(self.post[end - 1], return_counts=True)
        k = int(times.argmax())
        if 9 * int(times[k]) >= 4 * (n + int(self.n[last[k]])):
            yield i, int(last[k])
            self.union(i, int(last[k]))
        apart = self.mixed[item] | (self.label[self.post[start]] != self.label[i])
        if np.count_nonzero(apart) < least:
            return
        item, start, end = item[apart], start[apart], end[apart]
        order = np.argsort(start - end, kind="stable")  # long lists first
        many = min(least - 1, int(least / (SKIP * math.log2(int(end[order[0]] - start[order[0]]) + 1) + 1)))
        long, short, need = order[:many], order[many:], least - many
        small = int(np.searchsorted(self.n, -(-4 * n // 5)))  # sets before this one are too small
        lists = [self.post[a:z] for a, z in zip(start[short].tolist(), end[short].tolist(), strict=True)]
        lists = [x[(x >= small) & (self.label[x] != self.label[i])] for x in lists]
        lists = [x for x in lists if len(x)]
        if len(lists) < need:
            return
        number, count = _heap_merge([x.tolist() for x in lists], need) if sum(map(len, lists)) <= MERGE else _run_merge(lists, need)
        enough = 4 * (n + self.n[number])
        order = np.argsort(-count, kind="stable")
        number, count, enough = number[order], count[order], enough[order]
        size = 1
        while len(number):
            open_ = (self.label[number] != self.label[i]) & (9 * (count + len(long)) >= enough)
            number, count, enough = number[open_], count[open_], enough[open_]
            j, c, e = number[:size], count[:size], enough[:size]
            probe = (item[long] * len(self.n))[None, :] + j[:, None]
            found = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            for x in j[9 * (c + (self.keys[found] == probe).sum(1)) >= e].tolist():
                if self.label[x] != self.label[i]:
                    yield i, x
                    self.union(i, x)
            number, count, enough = number[size:], count[size:], enough[size:]
            size = min(2 * size, 64)


def _heap_merge(lists: list[list[int]], need: int) -> tuple[np.ndarray, np.ndarray]:
    """What is in ``need`` lists at least and in how many, by a heap that skips ahead."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    number, count = [], []
    while len(heap) >= need:
        least, popped = heap[0][0], []
        while heap and heap[0][0] == least:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            number.append(least)
            count.append(len(popped))
            jump = least + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            jump = heap[0][0]  # nothing below can be in ``need`` lists
        for _, k, at in popped:
            x = lists[k]
            if (at := bisect_left(x, jump, at)) < len(x):
                heapq.heappush(heap, (x[at], k, at))
    return np.array(number, np.int64), np.array(count, np.int64)


def _run_merge(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for long inputs: one sort merges the ascending runs."""
    every = np.sort(np.concatenate(lists), kind="stable")
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    count = np.diff(np.append(new, len(every)))
    return every[new[count >= need]], count[count >= need]


def _linked(sig: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    order = np.lexsort((sig, n))
    order = order[np.concatenate([[True], sig[order][1:] != sig[order][:-1]])]  # a set of several groups counts once
    sig, n = sig[order], n[order]
    found = np.array(list(Index([sets[i] for i in order], n).links()), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(sig[found[:, 0]]), pa.array(sig[found[:, 1]])], ["a", "b"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (group, i, j, sig, n, items) in order of the first three; small groups are searched together."""
    sig, n, sets, items, last = [], [], [], 0, None
    for batch in batches:
        group, i, j, s, m = (batch.column(c).to_numpy() for c in range(5))
        values, off = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        new[0] = last != (group[0], i[0], j[0]) if len(new) and batch.num_rows else False
        for k in range(batch.num_rows):
            if new[k] and items >= GROUP_ITEMS:
                yield _linked(np.array(sig), np.array(n), sets)
                sig, n, sets, items = [], [], [], 0
            sig.append(s[k])
            n.append(m[k])
            sets.append(values[off[k] : off[k + 1]].copy())
            items += len(sets[-1])
        if batch.num_rows:
            last = (group[-1], i[-1], j[-1])
    if sets:
        yield _linked(np.array(sig), np.array(n), sets)
    del sig, n, sets
    release()


def class_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of each document, and (sig, n, doc_id) of each class with words, with its smallest doc_id."""
    signed = written(docs.mapInArrow(_signatures, "doc_id long, n long, sig long"), "signed")
    return signed, signed.filter("n > 0").groupBy("sig").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes, written; over all of them, linked classes are connected. What leads to them is deleted then."""
    credit = docs.mapInArrow(_counted, "key long, sig long, credit int, n int").repartition("key").mapInArrow(_credited, "sig long, credit long, n long")
    enough = F.least(F.lit(EXTRA), F.ceil(F.ceil(F.col("n") * 4 / F.lit(5)) * 4 / F.lit(5)))
    hopeful = written(credit.groupBy("sig").agg(F.sum("credit").alias("credit"), F.max("n").alias("n")).filter(F.col("credit") >= enough).select("sig").join(classes, "sig").select("sig", "doc_id"), "hopeful")
    items = whole_sets(docs, hopeful)
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    sets = items.join(held, "item").groupBy("sig").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("df", "item"))).alias("s"))
    sets = written(sets.filter(F.size("s") * 5 >= F.col("n") * 4).select("sig", "n", F.col("s.item").alias("items")), "sets")
    # rarest first: items that no other set has fill the head of the prefix
    free = F.col("n") - F.ceil(F.col("n") * 4 / F.lit(5)) + 1 - (F.col("n") - F.size("items"))
    heads = written(sets.select("sig", F.explode(F.slice("items", 1, F.greatest(F.lit(0), free).cast("int"))).alias("item")), "heads")
    # two partners share an item of their heads, and so the first holder of it, whose group both are in
    first = heads.groupBy("item").agg(F.min("sig").alias("group"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    placed = heads.join(first, "item").select("sig", "group").distinct().join(sets, "sig")
    parts = placed.groupBy("group").agg(F.sum(F.size("items")).alias("total"))
    parts = written(parts.withColumn("parts", F.ceil(F.col("total") / F.lit(GROUP_ITEMS)).cast("int")), "parts")
    work = parts.agg(F.sum(F.col("total") * F.col("parts"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    dealt = placed.join(parts, "group").withColumn("side", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("group", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "sig", "n", "items")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / TASK_ITEMS))
    found = written(dealt.repartition(tasks, "group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_searched, "a long, b long"), "links")
    for done in (hopeful, sets, heads, parts):
        discarded(done)
    return found


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links of similarity 0.8 or more) of each document.

    Null and empty texts have no shingles and are linked with nothing, nor is a class of which every doc_id is null. A
    repeated doc_id is a row of its own. Equal sets are one class from the start, so copies cost one row each. Very long
    texts are cut into words piece by piece. Other columns are not read. Sets and their elements are told apart by 64-bit
    hashes, of words of up to seven bytes without collisions.
    """
    docs = text_only(docs)
    signed, classes = class_table(docs)
    found = components(links(docs, classes))
    classes = classes.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = classes.join(least, "root").select("sig", "component_id")
    out = signed.filter("n > 0").join(of, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; of rows equal in doc_id and text one stays.

    Rows with a null doc_id all stay, as do different texts of one doc_id that are no near copies of another doc_id. The ids that go and
    the repeated ones are broadcast up to BROADCAST_ROWS, so that texts stay where they are; beyond, texts and ids are shuffled.
    """
    firsts = F.count_if(F.col("doc_id") == F.col("component_id"))
    marked = written(join(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(firsts.alias("__n")).filter("__n <> 1"), "marked")
    total, repeats = marked.agg(F.count(F.lit(1)), F.count_if(F.col("__n") > 1)).first()
    few = F.broadcast if total <= BROADCAST_ROWS else lambda x: x
    alone = docs.join(few(marked.select("__id")), docs["doc_id"] == F.col("__id"), "left_anti")
    if not repeats:
        return alone
    repeated = docs.join(few(marked.filter("__n > 1").select("__id")), docs["doc_id"] == F.col("__id"), "left_semi")
    return alone.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
