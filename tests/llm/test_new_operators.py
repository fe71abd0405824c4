"""Collocations, manifest and url filters against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import _words, collocations, manifest, url_filter

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def test_word_hashes_differ_by_length():
    words = [bytes(97 + i % 26 for i in range(n)) + b"\0" * z for n in range(1, 41) for z in range(10)]
    words += [b"abc\0\0\0\0\x03", b"abc"]
    h = _words.hashes(_words.split(pa.array(words, pa.binary())))
    assert len(set(h.tolist())) == len(set(words))


# 11
def plain_collocations(rows, most=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < 10 or any(100 * f[t] >= 50 * a and f[t] >= 10 for t in longer_of(f, lang, w)):
            continue
        score, _, left, right = min((10**6 * a * a // (x * y), k, x, y) for k in range(1, len(w)) for x, y in [(f[lang, *w[:k]], f[lang, *w[k:]])])
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rs in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rs)[:most]))


_LONGER: dict = {}


def longer_of(f, lang, w):
    if len(w) > 2:
        return []
    if id(f) not in _LONGER:
        _LONGER.clear()
        index = _LONGER[id(f)] = defaultdict(list)
        for t in f:
            if len(t) == 4:
                index[t[0], t[1], t[2]].append(t)
                index[t[0], t[2], t[3]].append(t)
    return _LONGER[id(f)][lang, w[0], w[1]]


def test_collocations(spark, sf, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(9)] + ["New", "YORK", "City", "x\0y", "é", "a\u00a0b"]
    rows = [(r.choice([None, "en", "de", ""]), r.choice([None, "", "  \t", *([" ".join(r.choices(vocabulary, range(15, 0, -1), k=r.randrange(1, 60))).replace("w7 ", r.choice(". ,\n\r\v".split(" ")) + " ") + r.choice(["", ". new york\tcity! new  york city"])] * 20)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = plain_collocations(rows)
    assert len(want) > 50
    assert sorted(map(tuple, collocations.collocations(df).collect())) == want
    assert sorted(map(tuple, collocations.collocations(df, most=3).collect())) == plain_collocations(rows, 3)
    # a sample that proposes nothing, and one that proposes all, close to the same rows
    _, passes = collocations.phrases(df, lowered=10**6)
    assert passes == 3
    assert sorted(map(tuple, collocations.collocations(df, lowered=10**6).collect())) == want
    assert sorted(map(tuple, collocations.collocations(df, share=1, lowered=1).collect())) == want and collocations.phrases(df, share=1, lowered=1)[1] == 1
    monkeypatch.setattr(collocations, "CHUNK", 64)  # texts are cut between pieces
    monkeypatch.setattr(collocations, "BITS", 1 << 10)  # nearly full bitmaps
    assert sorted(map(tuple, collocations.collocations(df).collect())) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain_collocations([(x.lang, x.text) for x in docs.collect()])


def test_collocations_large_counts(spark):
    counts = spark.createDataFrame([("en", "", 0, 10**13), ("en", "a", 1, 3 * 10**12), ("en", "b", 1, 4 * 10**12), ("en", "a b", 2, 2 * 10**12 + 1)], "lang string, phrase string, words int, n long")
    row = collocations.scored(counts).first()
    assert (row.score, row.l, row.r, row.contained) == (10**6 * (2 * 10**12 + 1) ** 2 // (12 * 10**24), 3 * 10**12, 4 * 10**12, False)


def test_collocations_odd_tables(spark, odd, none):
    got = collocations.collocations(odd.withColumn("lang", odd["source"])).collect()
    assert got and {r.lang for r in got} <= {"a", "b", "c", "und"}
    assert collocations.collocations(none).count() == 0


# 12
def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i - i % 3
            yield "".join(level[first:i]), "".join(level[i + 1 : first + 3])
            i //= 3

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    crown = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            steps = [*path(trees[s], i), *path(crown, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].replace("\n", "")) if tampered else r)
            for a, z in steps:
                h = sha(a + h + z)
            out.append((r[0], leaf(r), trees[s][-1][0], crown[-1][0], sha("".join(a + z for a, z in steps)), h, h == crown[-1][0], i))
    return sorted(out, key=str)


ODD_IDS = [None, 5, 5, 7, -3, 1 << 62, -(1 << 63), (1 << 63) - 1] * 40 + [*range(-50, 3000)]


def _rows(kind):
    r = random.Random(3)
    return {
        "odd": lambda: [(r.choice(ODD_IDS), r.choice([None, "a", "a", "b", "", "é"]), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "x\ny", "é\n"])) for _ in range(2000)],
        "several arrays": lambda: [(i, "s", None, 1, "t\n") for i in range(2200)] + [(i, f"q{i}", None, 1, "t") for i in range(10)],
        "one": lambda: [(1, "s", None, 1, "t")],
        "equal rows": lambda: [(1, "s", None, 1, "t")] * 900,
        "one id": lambda: [(4, "s", None, 1, f"t\n{i}") for i in range(900)],
    }[kind]()


@pytest.mark.parametrize("kind", ["odd", "several arrays", "one", "equal rows", "one id"])
def test_manifest(spark, tmp_path, kind):
    rows = _rows(kind)
    spark.createDataFrame(rows, DOC).selectExpr("*", "'x' AS g", "1 AS place").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, manifest.op12_manifest(spark, str(tmp_path)).collect()), key=str) == plain_manifest(rows)


def test_manifest_rank_is_order(spark):
    r = random.Random(8)
    ids = [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [r.randrange(0, 1 << k) for k in range(1, 50) for _ in range(20)] + [0, 0, 63, 64, 4095, 4096]
    rows = manifest.ranked(manifest.leaves(spark.createDataFrame([(i, "s", None, None, None) for i in ids], DOC))).collect()
    assert [x.doc_id for x in sorted(rows, key=lambda x: x.place)] == sorted(ids) and sorted(x.place for x in rows) == list(range(len(ids)))


def test_manifest_odd_tables(spark, odd, none):
    from pyspark.sql import functions as F

    odd = odd.withColumn("n_chars", F.lit(None).cast("long"))
    got = manifest.manifest(odd).collect()
    assert len(got) == odd.count() and all(r.verified for r in got)
    assert manifest.manifest(none.withColumn("n_chars", F.lit(1))).count() == 0


# 13
def test_url_parts(spark):
    urls = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "https://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
        "x://m.example.com/en": ("m.example.com", "/en", "com/", "allow"), "://a.net/es/": ("a.net", "/es/", "net/es/", "block"), "http://net/fr/1": ("net", "/fr/1", "net/fr/", "block"),
        "http://a.com": ("a.com", "", None, "allow"), "http://a.com?/": ("a.com", "", None, "allow"), "http://acom/": ("acom", "/", None, "allow"), "http://a.com:80/": ("a.com:80", "/", None, "allow"),
        "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "a\nb://ÄB.com/x\ny": ("Äb.com", "/x\ny", "com/", "allow"), "http://x://y/z": ("x:", "//y/z", None, "allow"),
    }
    pages = spark.createDataFrame([(i % 3 or None, u, "own") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert sorted(((r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(urls.values(), key=str)
    kept = url_filter.keep_allowed(pages, spark.createDataFrame([], "page_id long, bad int"))
    assert kept.columns == pages.columns and sorted((r.url or "" for r in kept.collect())) == sorted(u or "" for u, v in urls.items() if v[3] == "allow") and {r.host for r in kept.collect()} == {"own"}
    assert url_filter.judge(pages.filter("false"), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_registered_domains(spark):
    from pyspark.sql import functions as F

    want = {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "example.com:8080": ("example.com", "com"), "com": ("com", "com"), "co.uk": ("co.uk", "co.uk"), "x.example.org.": ("example.org", "org"), "10.0.0.1": ("10.0.0.1", ""), "": ("", "")}
    name = url_filter.name_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in want], "h string").select("h", url_filter.domain_of(name), url_filter.suffix_of(name)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_reputations(spark, monkeypatch):
    """Bad domains are blocked with the hosts of theirs that have no labels; one bad page alone blocks nothing."""
    r = np.random.default_rng(2)
    pages, judged, i = [], [], 0
    for d in range(40):
        rate = 0.97 if d % 8 == 0 else 0.05
        for h in range(6):
            for _ in range(30):
                i += 1
                pages.append((i, f"http://h{h}.d{d}.test/x"))
                if h < 5:
                    judged.append((i, int(r.random() < rate)))
    pages += [(10**6, "http://lone.one.test/"), (10**6 + 1, "http://lone.one.test/")]
    judged.append((10**6, 1))
    p, j = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(judged, "page_id long, bad int")
    got = url_filter.judge(p, j).collect()
    blocked = {x.host for x in got if x.verdict == "block"}
    assert blocked == {f"h{h}.d{d}.test" for d in range(0, 40, 8) for h in range(6)}
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", 0)  # by the join with salts
    assert sorted(map(tuple, url_filter.judge(p, j).collect())) == sorted(map(tuple, got))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {(x.page_id, x.bad) for x in url_filter.outcomes(labels).collect()} == {(1, 1), (2, 1), (3, 0)}


# 9: layers to the fixpoint
def test_secrets_behind_chance_heads_gaps_and_glue():
    import base64
    import bz2
    import gzip
    import lzma
    import time

    from hearthline.llm import secret_scan

    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    plain = "my long token = abcdefgh1234"
    cases = ["x/" + b64(b64(plain)), "x/" + b64("".join(f"%{c:02x}" for c in plain.encode())), "x/" + b64(plain.encode("utf-16-le")), b64(b"matrix x^2 + y " + gzip.compress(plain.encode())), b64(b"matrix z2 + y " + gzip.compress(plain.encode())), b64(gzip.compress(b"a") + b"GAPGAP" + gzip.compress(plain.encode())),
             b64(gzip.compress(b"matrix x^2 " + gzip.compress(plain.encode()) + b"GAP" + bz2.compress(plain.encode())))]
    for text in cases:
        _, spans, _ = secret_scan.scan("before " + text + " behind")
        assert [(k, 7 <= a < z <= 7 + len(text)) for a, k, z in spans] and all(k == 0 for _, k, _ in spans), text
    r = random.Random(12)
    wraps = [b64, lambda x: b64(gzip.compress(x.encode())), lambda x: b64(bz2.compress(x.encode())), lambda x: b64(lzma.compress(x.encode())), lambda x: "".join(f"%{c:02X}" for c in x.encode()), lambda x: "".join(f"\\x{c:02x}" for c in x.encode()), lambda x: "".join(f"&#{c};" for c in x.encode()), lambda x: "".join(f"\\u{ord(c):04x}" for c in x), lambda x: "".join(f"\\x{c:02x}" for c in gzip.compress(x.encode()))]
    for _ in range(300):
        text = plain
        for _ in range(3):
            text = r.choice(wraps)(text)
        assert secret_scan.scan("say " + text + " end")[1], text
    for text in ("\\x1f\\x8b\\x08" * 20_000, "\\x1f\\x8b\\x08\\x00" * 20_000):
        began = time.process_time()
        secret_scan.scan(text)
        assert time.process_time() - began < 10


# 3: exact beyond doubles
@pytest.mark.parametrize("size", [10**3, 10**6, 10**9])
def test_top_k_of_large_components(spark, size):
    from hearthline.llm import topk

    r = random.Random(size)
    v = {i: [float(r.randrange(-size, size)) for _ in range(4)] for i in range(300)}
    v |= {i: v[i - 1] for i in range(201, 300, 7)}  # ties
    n = {i: [math.floor(256 * c) for c in x] for i, x in v.items()}
    score = lambda q, c: sum(a * b for a, b in zip(n[q], n[c], strict=True))
    want = [(q, k, c, -x) for q in v if q % 50 == 0 for k, (x, c) in enumerate(sorted((-score(q, c), c) for c in v if c != q)[:5], 1)]
    d = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    if size < 10**9:
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(d, block=64, query_block=4).collect()) == want
    else:
        with pytest.raises(Exception, match="no long"):
            topk.top_k(d).collect()
    huge = spark.createDataFrame([(0, [1e17]), (1, [1 / 256]), (2, [0.0]), (3, [-1 / 256])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no long"):
        topk.top_k(huge).collect()
    assert [(x.vec_id, x.score) for x in topk.top_k(huge.selectExpr("vec_id", "transform(embedding, x -> x / 100) AS embedding")).collect()] == [(1, 0), (2, 0), (3, -256 * 10**15)]
