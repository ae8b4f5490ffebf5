"""Connected components: smallest vertices, and rounds that work on what is left of the graph."""

import random

import pytest

from tidewell.llm import components


def smallest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((v, find(v)) for v in list(root))


def chosen(n, k):
    rnd = random.Random(n)
    return [(rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(k)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(999, i) for i in range(200)], [(-1, i) for i in range(200)], chosen(150, 170), chosen(40, 400)])
def test_smallest_vertex_of_each(spark, edges):
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == smallest(edges)


def test_edges_fall_from_round_to_round(spark, monkeypatch):
    """A group whose members meet in many lists: all rounds together join about as many edges as are given."""
    edges = sorted({(min(e), max(e)) for e in chosen(300, 9000) if e[0] != e[1]})
    written, stage = [], components.stage

    def counted(df, name):
        out = stage(df, name)
        if name == "edges":
            written.append(out.count())
        return out

    monkeypatch.setattr(components, "stage", counted)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == smallest(edges)
    assert written[-1] == 0 and sum(written) < 1.5 * len(edges)
