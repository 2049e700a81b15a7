"""Overlaps and groups on dense pages, against all pairs."""

from __future__ import annotations

import random

import pytest

from leafmill.operators import layout

SCHEMA = "doc_id long, page_no int, id int, label string, l double, t double, r double, b double, conf double, cells array<struct<idx:int,l:double,t:double,r:double,b:double>>, is_orphan boolean, ord int, cls string"


def strong(x, y) -> bool:
    if x[4] == y[4] is True:
        return False
    own, other = (x[2] - x[0]) * (x[3] - x[1]), (y[2] - y[0]) * (y[3] - y[1])
    inter = max(0.0, min(x[2], y[2]) - max(x[0], y[0])) * max(0.0, min(x[3], y[3]) - max(x[1], y[1]))
    return own > 0 and other > 0 and (inter / (own + other - inter) > 0.8 or inter / own > 0.8 or inter / other > 0.8)


def page(rng: random.Random, n: int, reach: float) -> list[tuple]:
    out = []
    for _ in range(n):
        l, t = rng.uniform(0, 600), rng.uniform(0, 780)  # noqa: E741
        w, h = rng.choice(((8, 8), (40, 12), (reach, reach), (0, 5)))
        out.append((l, t, l + w, t + h, rng.random() < 0.3))
    return out + [(out[k][0] + 0.2, out[k][1], out[k][2] + 0.2, out[k][3], False) for k in range(0, n, 5)]


@pytest.mark.parametrize(("n", "reach", "folded"), [(12, 300, 64), (400, 120, 64), (400, 200, 4)])
def test_pairs_and_groups_as_by_all_pairs(spark, monkeypatch, n, reach, folded):
    monkeypatch.setattr(layout, "FOLDED", folded)
    rng = random.Random(n)
    pages = {no: page(rng, n, reach) for no in (1, 2)}
    rows = [(7, no, k, "text", *map(float, x[:4]), 0.9, [], x[4], k, "regular") for no, own in pages.items() for k, x in enumerate(own)]
    frame = spark.createDataFrame(rows, SCHEMA)
    pairs = frame.sparkSession.createDataFrame(layout.overlap_pairs(frame).collect(), "doc_id long, page_no int, cls string, a int, b int")
    got = [(r.page_no, r.a, r.b) for r in pairs.collect()]
    want = {(no, a, b) for no, own in pages.items() for b in range(len(own)) for a in range(b) if strong(own[a], own[b])}
    assert len(got) == len(want) and set(got) == want
    root = {(no, k): k for no, own in pages.items() for k in range(len(own))}
    changed = True
    while changed:
        changed = False
        for no, a, b in want:
            least = min(root[no, a], root[no, b])
            changed |= root[no, a] != least or root[no, b] != least
            root[no, a] = root[no, b] = least
    found = {(r.page_no, r.id): r.root for r in layout.group_roots(pairs).collect()}
    assert found == {k: v for k, v in root.items() if any(k in ((no, a), (no, b)) for no, a, b in want)}


def test_a_page_of_many_clusters(spark):
    rows = [(1, 1, k, "text", 10.0 * (k % 64), 12.0 * (k // 64), 10.0 * (k % 64) + 8, 12.0 * (k // 64) + 10, 0.9, [], False, k, "regular") for k in range(3200)]
    rows.append((1, 1, 3200, "code", 0.0, 0.0, 30.0, 40.0, 0.9, [], False, 3200, "regular"))
    out = layout.refined(spark.createDataFrame(rows, SCHEMA).drop("cls"))
    inside = {k for k in range(3200) if 10 * (k % 64) + 8 <= 30 and 12 * (k // 64) + 10 <= 40}
    assert {r.id for r in out.select("id").collect()} == set(range(3201)) - inside
