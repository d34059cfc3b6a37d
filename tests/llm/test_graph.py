import random

from weekgrain.llm.graph import components


def test_components_of_random_graphs(shipped):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)] + [(5, None), (7, 7)]
    group = {}

    def top(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = top(a), top(b)
            group[max(x, y)] = min(x, y)
    rows = components(shipped.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(group)
    assert {r["node"]: r["component"] for r in rows} == {x: top(x) for x in group}


def test_no_edges(shipped):
    assert components(shipped.createDataFrame([], "a long, b long")).count() == 0
