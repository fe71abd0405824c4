"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word of a window enters as a word vector and a pooled vector of its character 4-grams, both with a fixed log-odds
input beside the trained ones. A GRU reads the window in each direction, attention pools its states, and a logistic
unit scores the window. A text's score is the highest of all its overlapping windows; training follows that: the
gradient goes through each text's highest window.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import release, ship, small_batches, table, text_only
from ._words import chunks

ship(__name__)

WINDOW, STRIDE = 64, 48
HIDDEN, ATTEND, EMBED = 8, 8, 6
GRAM, GRAM_BITS = 4, 15
CELLS = 64 * 1024  # words in a batch of windows, padding included
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    grams: np.ndarray  # bucket of each character 4-gram
    gram_first: np.ndarray  # of each word, its first gram
    first: np.ndarray  # of each text, its first word; one more entry at the end


def words_of(column: pa.Array, piece: int = 256 << 10) -> Words:
    """Words and their grams, worked out over about ``piece`` bytes at a time."""
    _, off = _words.buffers(column)
    parts, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + piece, "right")) - 1)
        parts.append(_words_of(column.slice(lo, hi - lo)))
        lo = hi
    if len(parts) == 1:
        return parts[0]
    grams, words = np.cumsum([0] + [len(p.grams) for p in parts]), np.cumsum([0] + [len(p.hashes) for p in parts])
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    first = join([p.first[:-1] + a for p, a in zip(parts, words, strict=False)])
    return Words(join([p.hashes for p in parts]), join([p.grams for p in parts]), join([p.gram_first + a for p, a in zip(parts, grams, strict=False)]), np.append(first, words[-1]).astype(np.int64))


def _words_of(column: pa.Array) -> Words:
    """A gram starts with the sign before the word or one of its bytes, and stays inside the word and the sign after it."""
    w = _words.split(column, _words.NOT_ALNUM)
    n = w.ends - w.starts
    k = np.maximum(1, n + 3 - GRAM)  # grams of "^word$"
    first = np.concatenate([[0], np.cumsum(k)])[:-1]
    data = np.concatenate([[0], FOLD[w.data], np.zeros(GRAM, np.uint8)]).astype(np.uint64)
    word = np.repeat(np.arange(len(n)), k)
    at = w.starts[word] + np.arange(len(word)) - first[word]  # in ``data``: one before the byte it has in the text
    left = w.ends[word] + 1 - at  # up to the word's end, for cutting off what follows
    code = np.zeros(len(word), np.uint64)
    begins = at == w.starts[word]
    for i in range(GRAM):
        c = np.where((left > i) & ~(begins & (i == 0)), data[np.minimum(at + i, len(data) - 1)], 1)
        code = code * np.uint64(257) + c
    return Words(_words.hashes(w, lower=True), (_words.mix(code) >> np.uint64(64 - GRAM_BITS)).astype(np.int32), first, w.first)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of every window; they overlap by WINDOW - STRIDE words, and a text of words has one at least."""
    n = np.diff(first)
    m = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), m)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(m) - m, m)) * STRIDE
    return text, first[text] + start, np.minimum(WINDOW, n[text] - start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the forward pass and its gradients."""

    def __init__(self, vocabulary: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray, base: float, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        d = 2 * EMBED + 3
        self.vocabulary, self.word_odds, self.gram_odds, self.base = vocabulary, word_odds.astype(np.float32), gram_odds.astype(np.float32), base
        self.p = {
            "word": 0.1 * r.standard_normal((len(vocabulary) + 1, EMBED)).astype(np.float32), "gram": 0.1 * r.standard_normal((1 << GRAM_BITS, EMBED)).astype(np.float32),
            "W": f(2, d, 3 * HIDDEN), "U": f(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "A": f(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": f(ATTEND, 1)[:, 0], "w": f(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32),
        }

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary; 0: not in it."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == h, at + 1, 0) if len(self.vocabulary) else np.zeros(len(h), np.int64)

    def inputs(self, w: Words, ids: np.ndarray) -> np.ndarray:
        """A row of features per word."""
        out = np.empty((len(ids), 2 * EMBED + 3), np.float32)
        ends = np.append(w.gram_first, len(w.grams))
        for lo in range(0, len(ids), 65536):
            hi = min(len(ids), lo + 65536)
            first, grams, x = ends[lo:hi] - ends[lo], w.grams[ends[lo] : ends[hi]], out[lo:hi]
            count = np.diff(ends[lo : hi + 1])[:, None].astype(np.float32)
            odds = self.gram_odds[grams]
            x[:, :EMBED] = self.p["word"][ids[lo:hi]]
            x[:, EMBED : 2 * EMBED] = np.add.reduceat(self.p["gram"][grams], first) / count
            x[:, -3], x[:, -2], x[:, -1] = np.maximum.reduceat(odds, first), np.add.reduceat(odds, first) / count[:, 0], self.word_odds[ids[lo:hi]]
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ``index`` (time, window) points into the rows ``x``."""
        p, (steps, batch) = self.p, index.shape
        proj = np.matmul(x[None], p["W"]) + p["b"]
        states = np.zeros((2, steps, batch, HIDDEN), proj.dtype)
        h, memo = np.zeros((2, batch, HIDDEN), proj.dtype), []
        for t in range(steps):
            at = (t, steps - 1 - t)
            a = np.stack([proj[d, index[at[d]]] for d in (0, 1)])
            m = np.stack([mask[at[d]] for d in (0, 1)])[..., None]
            g = np.matmul(h, p["U"])
            zr = sigmoid(a[..., : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(a[..., 2 * HIDDEN :] + r * g[..., 2 * HIDDEN :])
            new = h + m * (1 - z) * (n - h)
            if keep:
                memo.append((h, z, r, n, g[..., 2 * HIDDEN :], m))
            h = new
            states[0, at[0]], states[1, at[1]] = h[0], h[1]
        s = np.concatenate([states[0], states[1]], -1)
        u = np.tanh(s @ p["A"] + p["a"])
        e = np.where(mask, u @ p["v"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = (e / e.sum(0))[..., None]
        pooled = (alpha * s).sum(0)
        logit = pooled @ p["w"] + p["c"][0]
        return (logit, (memo, s, u, alpha, pooled)) if keep else logit

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, kept: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the parameters above the inputs, and of the input rows."""
        p, (memo, s, u, alpha, pooled), steps = self.p, kept, len(index)
        g = {"w": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["w"]
        d_alpha = (s * d_pool).sum(-1, keepdims=True)
        d_s = alpha * d_pool
        d_e = (alpha * (d_alpha - (alpha * d_alpha).sum(0)))[..., 0]
        d_u = d_e[..., None] * p["v"] * (1 - u**2)
        g |= {"v": np.einsum("tb,tba->a", d_e, u), "A": np.einsum("tbs,tba->sa", s, d_u), "a": d_u.sum((0, 1))}
        d_s = d_s + d_u @ p["A"].T
        d_u_all, d_proj = np.zeros_like(p["U"]), np.zeros((2, len(x), 3 * HIDDEN), x.dtype)
        d_h = np.zeros_like(memo[0][0])
        for t in reversed(range(steps)):
            at = (t, steps - 1 - t)
            h, z, r, n, gn, m = memo[t]
            d_h = d_h + np.stack([d_s[at[0], :, :HIDDEN], d_s[at[1], :, HIDDEN:]])
            d_new = m * d_h
            dz, dn = d_new * (h - n) * z * (1 - z), d_new * (1 - z) * (1 - n**2)
            dr = dn * gn * r * (1 - r)
            d_a, d_g = np.concatenate([dz, dr, dn], -1), np.concatenate([dz, dr, dn * r], -1)
            d_u_all += np.matmul(h.transpose(0, 2, 1), d_g)
            d_h = (1 - m) * d_h + d_new * z + np.matmul(d_g, p["U"].transpose(0, 2, 1))
            for d in (0, 1):
                np.add.at(d_proj[d], index[at[d]], d_a[d])
        g |= {"U": d_u_all, "W": np.matmul(x.T[None], d_proj), "b": d_proj.sum(1, keepdims=True)}
        return g, np.matmul(d_proj, p["W"].transpose(0, 2, 1)).sum(0)

    def window_logits(self, x: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of all windows, run in batches of like length."""
        out, order = np.empty(len(start), np.float32), np.argsort(length, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and length[order[min(len(order), hi * 2 - lo) - 1]] * (min(len(order), hi * 2 - lo) - lo) <= CELLS:
                if (hi := min(len(order), hi * 2 - lo)) == len(order):
                    break
            b = order[lo:hi]
            index, mask = _grid(start[b], length[b])
            out[b] = self.forward(x, index, mask)
            lo = hi
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """From 0 to 1 for each text; one without words has the base rate of the training rows, or 0.49 if that is higher."""
        w = words_of(column)
        text, start, length = windows_of(w.first)
        best = np.full(len(column), -np.inf)
        if len(text):
            np.maximum.at(best, text, self.window_logits(self.inputs(w, self.word_ids(w.hashes)), start, length))
        return np.where(np.isfinite(best), sigmoid(np.where(np.isfinite(best), best, 0.0)), min(self.base, 0.49))


def _grid(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(int(length.max()))[:, None]
    mask = t < length
    return np.where(mask, start + t, start), mask


def _odds(of: np.ndarray, size: int, toxic: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """Smoothed log-odds of (text, item) pairs, each counted once a text: how much likelier the item is in toxic texts."""
    a, b = np.bincount(of[toxic], minlength=size), np.bincount(of[~toxic], minlength=size)
    return np.clip(np.log((a + 2.0) / (n[1] + 4.0)) - np.log((b + 2.0) / (n[0] + 4.0)), -4, 4) / 2


def train(texts: list[str], labels: list[int], steps: int = 200, batch: int = 32, rate: float = 0.01, decay: float = 0.3, min_texts: int = 5, most_words: int = 20_000, seed: int = 5) -> Network:
    """A network fitted to these texts in about ``steps`` batches, two rounds over all texts at least; the vocabulary holds
    the words of ``min_texts`` texts at least."""
    y = np.array(labels, np.float32)
    w = words_of(pa.array(texts, pa.string()))
    n = (int((y == 0).sum()), int((y == 1).sum()))
    text = np.repeat(np.arange(len(y)), np.diff(w.first))
    vocabulary, word = np.unique(w.hashes, return_inverse=True)
    pairs = np.unique(text * max(1, len(vocabulary)) + word)
    held = np.bincount(pairs % max(1, len(vocabulary)), minlength=len(vocabulary))
    keep = np.sort(np.argsort(-held, kind="stable")[:most_words])
    keep = keep[held[keep] >= min_texts]
    odds = _odds(pairs % max(1, len(vocabulary)), len(vocabulary), y[pairs // max(1, len(vocabulary))] == 1, n)[keep]
    gram_text = np.repeat(text, np.diff(np.append(w.gram_first, len(w.grams))))
    gram_pairs = np.unique(gram_text << GRAM_BITS | w.grams)
    del gram_text
    gram_odds = _odds(gram_pairs & (1 << GRAM_BITS) - 1, 1 << GRAM_BITS, y[gram_pairs >> GRAM_BITS] == 1, n)
    net = Network(vocabulary[keep], np.concatenate([[0], odds]), gram_odds, n[1] / max(1, sum(n)), seed)
    if not min(n):
        net.p["w"][:] = 0
        net.p["c"][:] = -4.0 if not n[1] else 4.0
        return net
    ids = net.word_ids(w.hashes)
    of, start, length = windows_of(w.first)
    r, step, m, v = np.random.default_rng(seed), 0, {}, {}
    for epoch in range(max(2, round(steps * batch / len(y)))):
        x = net.inputs(w, ids)
        # at first the window with the likeliest word or gram stands for the text, later the one that scores highest
        score = np.array([x[a : a + k, -1].max() + x[a : a + k, -3].max() for a, k in zip(start, length, strict=True)]) if epoch == 0 else net.window_logits(x, start, length)
        order = np.lexsort((-score, of))
        top = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
        for lo in range(0, len(top), batch):
            if lo == 0:
                r.shuffle(top)
            b = top[lo : lo + batch]
            index, mask = _grid(start[b], length[b])
            rows, index = np.unique(index, return_inverse=True)
            index = index.reshape(mask.shape)
            count = np.diff(np.append(w.gram_first, len(w.grams)))[rows]
            part = np.concatenate([np.arange(a, a + k) for a, k in zip(w.gram_first[rows], count, strict=True)])
            sub = Words(w.hashes[rows], w.grams[part], np.concatenate([[0], np.cumsum(count)])[:-1], np.zeros(1))
            x = net.inputs(sub, ids[rows])
            logit, kept = net.forward(x, index, mask, keep=True)
            g, dx = net.gradients(x, index, mask, kept, ((sigmoid(logit) - y[of[b]]) / len(b)).astype(np.float32))
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], ids[rows], dx[:, :EMBED])
            np.add.at(g["gram"], sub.grams, np.repeat(dx[:, EMBED : 2 * EMBED] / count[:, None], count, 0))
            step += 1
            for name, d in g.items():  # Adam
                m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                v[name] = 0.999 * v.get(name, 0) + 0.001 * d * d
                net.p[name] *= 1 - rate * decay
                net.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 500, clean_rows: int = 1000, most_chars: int = 4000) -> Network:
    """Trained on a bounded sample of the labelled rows that are not held out: ``toxic_rows`` and ``clean_rows`` in order of
    a hash of doc_id, of which those with texts over ``most_chars`` characters are left out. A doc_id with labels of both kinds
    counts as toxic; of several texts of one doc_id the least is taken, so that no doc_id brings more than one row."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda t, n: known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(pick(1, toxic_rows).union(pick(0, clean_rows)))  # bounded by the two parameters
    rows = text_only(docs).filter(F.length("text") <= most_chars).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text"), F.max("toxic")).collect()
    rows.sort(key=lambda x: x[0])
    net = train([x[1] for x in rows], [x[2] for x in rows])
    del rows
    release()
    return net


def save(net: Network, uri: str) -> None:
    """Stores a network as one file, in any store that pyarrow opens by its address."""
    from pyarrow import fs

    out = io.BytesIO()
    np.savez(out, vocabulary=net.vocabulary, word_odds=net.word_odds, gram_odds=net.gram_odds, base=net.base, **{f"p_{k}": v for k, v in net.p.items()})
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as f:
        f.write(out.getvalue())


def load(uri: str) -> Network:
    """A stored network, to score with as often as wanted after one training."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        kept = np.load(io.BytesIO(f.read()))
    net = Network(kept["vocabulary"], kept["word_odds"], kept["gram_odds"], float(kept["base"]))
    net.p = {k[2:]: kept[k] for k in kept.files if k.startswith("p_")}
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every document; null and empty texts get the base rate.

    Repeated rows and equal or null doc_ids are rows of their own, and equal texts score alike. Very long texts are scored
    in all their windows. Other columns are not read. An empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text", 1 << 20):
                s = held.value.scores(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(s.astype(float))], ["doc_id", "score"])
        release()

    out = text_only(docs).mapInArrow(rows, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with all their columns."""
    net = fit(docs, labels)
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text", 1 << 20):
                yield piece.filter(pa.array(held.value.scores(piece.column(at)) < 0.5))
        release()

    return docs.mapInArrow(rows, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
