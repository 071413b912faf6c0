"""Nearest neighbours against exact double-precision search."""

import math

import numpy as np
import pytest

from sparkweft.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, list int, score double, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3.0, "clash") for i, v in rows], SCHEMA)


def exact(rows, k, every):
    """The k best of each query among usable rows {vec_id: vector}."""
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float32).astype(float)
    for q in ids[ids % every == 0]:
        s = (x * x[np.searchsorted(ids, q)]).sum(1)
        s[ids == q] = -np.inf
        yield int(q), [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]


def check(got, rows, k, every):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, want in exact(rows, k, every):
        own = sorted(by.pop(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(want) + 1))
        assert len({r["vec_id"] for r in own} - {q}) == len(own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        for r in own:
            exact_score = float(np.dot(np.array(rows[q], np.float32).astype(float), np.array(rows[r["vec_id"]], np.float32).astype(float)))
            assert math.isclose(r["score"], exact_score, rel_tol=1e-12, abs_tol=1e-12)
        hits += len({r["vec_id"] for r in own} & {i for i, _ in want})
        total += len(want)
    assert not by
    return hits / max(1, total)


@pytest.mark.parametrize("unit", [True, False])
def test_recall(spark, unit):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.7 * rng.standard_normal((3000, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.2, 3, (3000, 1))
    rows = dict(enumerate(x.tolist()))
    found = neighbours.nearest(frame(spark, rows.items()))
    share = check(found.collect(), rows, 20, 20)
    assert share >= 0.95
    assert neighbours.recall(found, frame(spark, rows.items())) == pytest.approx(share, abs=1e-3)


def test_hot_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # the hot list has many blocks and many parts of queries
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8))
    x[::3] = 4 * x[0]  # longer than the others, so its copies are each other's nearest
    rows = dict(enumerate(x.tolist()))
    got = neighbours.nearest(frame(spark, rows.items()), k=5, every=2).collect()
    assert check(got, rows, 5, 2) >= 0.9
    hot = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 6), key=lambda r: r["rank"])]
    assert hot == [0, 3, 9, 12, 15]


def test_rows_that_take_no_part(spark):
    fine = {20: [1, 0, 1], 40: [0, 1, 1], 1: [1, 1, 1], 2: [-1, 0.5, 2], 7: [5, 5, 5]}
    odd = [(60, None), (80, [0, 0, 0]), (100, [1, None, 1]), (3, [math.nan, 1, 1]), (4, [math.inf, 0, 0]), (5, []), (120, [1, 1]), (None, [1, 1, 1]), (7, [5, 5, 5]), (7, [6, 9, 9])]
    got = neighbours.nearest(frame(spark, [*fine.items(), *odd])).collect()
    assert check(got, fine, 20, 20) == 1
    assert {r["query_id"] for r in got} == {20, 40} and len(got) == 8


@pytest.mark.parametrize("rows", [[], [(20, None)], [(20, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])]])
def test_no_neighbours(spark, rows):
    assert neighbours.nearest(frame(spark, rows)).collect() == []
