"""Components: as few rounds as the edges need, as each costs the driver plans, stages and broadcasts."""

import random

import pytest

from ledgerspark.llm import _components


def _slow(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.fixture
def writes(monkeypatch):
    seen = []
    real = _components.kept
    monkeypatch.setattr(_components, "kept", lambda df, name: (seen.append(name), real(df, name))[1])
    return seen


def _found(spark, edges):
    rows = _components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    found = {r.node: r.component for r in rows}
    assert len(found) == len(rows)
    return found


def test_stars_need_no_round(spark, writes):
    edges = [(-5, x) for x in range(1, 40)] + [(x, 100) for x in range(101, 120)]
    assert _found(spark, edges) == _slow(edges)
    assert len(writes) == 1


def test_rounds_end_with_the_stars(spark, writes):
    edges = [(9, x) for x in range(1, 9)]
    assert _found(spark, edges) == _slow(edges)
    assert len(writes) == 2


def test_random_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(1000 + x, 1001 + x) for x in range(20)]
    assert _found(spark, [e for e in edges if e[0] != e[1]]) == _slow([e for e in edges if e[0] != e[1]])
    assert _found(spark, []) == {}
