"""Bounded k-means against all distances, with ties, empty centroids and few vectors."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from leafmill.llm import centroids


def brute(rows, k, rounds, scale=64):
    own = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in own]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            mine = [own[j][1] for j, (_, c) in enumerate(near) if c == n]
            if mine:
                centres[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    near = assign()
    total = sum(d for d, _ in near)
    by = [sum(d for d, c in near if c == n) for n in range(len(centres))]
    return sorted((str(i), c, d, by[c], total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(own, near, strict=True))


@pytest.mark.parametrize(("k", "rounds", "bounds"), [(16, 3, None), (7, 6, 1), (5, 4, 5), (1, 2, None), (900, 2, None)])
def test_as_by_all_distances(spark, k, rounds, bounds):
    rng = random.Random(k)
    spots = [[rng.uniform(-0.5, 0.5) for _ in range(4)] for _ in range(9)]
    rows = [(n, [round((x + rng.gauss(0, 0.12)) * 8) / 8 for x in spots[n % 9]]) for n in range(400)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (7, rows[8][1]), (500, [0.0] * 4), (501, [0.0] * 4)]
    bad = [(600, None), (601, [1.0, None, 0.0, 0.0]), (602, [float("nan"), 0.0, 0.0, 0.0]), (603, [float("inf"), 0.0, 0.0, 0.0]), (604, [1.0] * 5), (605, [1e30] * 4)]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, cluster int, distance string").repartition(3)
    got = centroids.clustered(frame, k=k, rounds=rounds, dims=4, bounds=bounds).collect()
    assert sorted((str(r.id), *r[1:]) for r in got) == brute(rows, k, rounds)


def test_no_vectors(spark):
    assert centroids.clustered(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_save_distances_and_never_the_answer():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(c, 3, (300, 8)) for c in rng.uniform(-60, 60, (12, 8))]).astype(np.int64)
    centres = vectors[rng.choice(len(vectors), 12, replace=False)].copy()
    own = centroids.Bounds.new(vectors, centres, 3)
    spared = 0
    for _ in range(6):
        before = centres.copy()
        for c in range(12):
            if (own.cluster == c).any():
                centres[c] = vectors[own.cluster == c].sum(axis=0) // (own.cluster == c).sum()
        own.moved(np.sqrt(((centres - before) ** 2).sum(axis=1)))
        own.depth[:] = -1
        own.settle(centres)
        spared += int((own.depth < 4).sum())
        assert (own.cluster == centroids.squared(vectors, centres).argmin(axis=1)).all()
    assert spared > 4 * len(vectors)
