"""Scores of documents of any shape against a plain walk."""

import json
import random

from hearthline.operators import documents as D


def plain(doc):
    """(total, filled, leaves, {path: present}) as a recursive walk tells them."""
    total, filled, leaves, fields = 0, 0, 0, {}
    todo = [("", doc)]
    while todo:
        at, x = todo.pop()
        named = isinstance(x, dict)
        for k, v in x.items() if named else enumerate(x):
            path = (f"{at}.{k}" if at else k) if named else f"{at}[{k}]"
            many = isinstance(v, (dict, list))
            there = many or (v is not None and str(v).strip() != "")
            if named or not many:
                total, filled = total + 1, filled + there
                fields[path] = max(fields.get(path, 0), int(there))
            leaves += not many and bool(v) and there
            if many:
                todo.append((path, v))
    return total, filled, leaves, fields


def made(r, depth):
    kind = r.random()
    if depth and kind < 0.35:
        return {r.choice(["a", "b", "é", "x y", "a.b"]): made(r, depth - 1) for _ in range(r.randrange(4))}
    if depth and kind < 0.6:
        return [made(r, depth - 1) for _ in range(r.randrange(4))]
    return r.choice([None, "", " \t", "x", "0", "null", 0, 0.0, 7, -2.5, 10**30, True, False])


def test_documents_of_mixed_shape(spark):
    r = random.Random(3)
    docs = [x for x in (made(r, 7) for _ in range(400)) if isinstance(x, (dict, list))]
    deep = "x"
    for i in range(30):
        deep = {"k": deep} if i % 2 else [deep]
    docs += [deep, {}, [], [[]], [{}], {"a.b": "", "a": {"b": 1}}]
    bad = [None, "", "x", "3", '"a"', "null", "{", '{"a":1,"a":2}']
    rows = [(i, json.dumps(d, ensure_ascii=False), "own") for i, d in enumerate(docs)] + [(-1 - i, b, None) for i, b in enumerate(bad)]
    d = spark.createDataFrame(rows, "id int, doc string, counted string")
    want = {i: plain(x) for i, x in enumerate(docs)} | {-1 - i: (0, 0, 0, {}) for i in range(len(bad))}
    got = {x.id: x for x in D.scores(d, "id", "doc").collect()}
    assert {i: (x.total, x.filled, x.leaves) for i, x in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(x.completeness == (x.filled / x.total if x.total else 0.0) for x in got.values())
    assert {(x.id, x.path): x.present for x in D.presence(d, "id", "doc").collect()} == {(i, p): v for i, w in want.items() for p, v in w[3].items()}


def test_repeated_keys_and_no_documents(spark):
    d = spark.createDataFrame([(1, '{"a":1}'), (1, '{"b":[""]}'), (None, "[1]"), (2, None), (3, '{"a":1} 2')], "id int, doc string")
    assert sorted((x.id or 0, x.total, x.filled, x.leaves) for x in D.scores(d, "id", "doc").collect()) == [(0, 1, 1, 1), (1, 3, 2, 1), (2, 0, 0, 0), (3, 1, 1, 1)]
    assert D.scores(d.filter("false"), "id", "doc").count() == 0 and D.presence(d.filter("id = 2"), "id", "doc").count() == 0
