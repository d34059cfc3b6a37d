import heapq

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weekgrain.llm import vector_index as vi

SCHEMA = "vec_id long, embedding array<float>, label int, copies int, node string"


def brute(rows, least=0.93):
    """vec_id -> (links, component) over all pairs."""
    links = {r[0]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a[0] == b[0] or a[2] is None or a[2] != b[2] or a[1] is None or b[1] is None:
                continue
            x, y = (np.array(v, dtype=np.float32).astype(float) if None not in v else np.zeros(0) for v in (a[1], b[1]))
            if len(x) != len(y) or not len(x) or not np.isfinite([*x, *y]).all() or not x.any() or not y.any():
                continue
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a[0]].add(b[0])
    out = {}
    for start in links:
        reach, todo = {start}, [start]
        while todo:
            for n in links[todo.pop()] - reach:
                reach.add(n)
                todo.append(n)
        out[start] = (len(links[start]), min(reach))
    return out


def vectors(rng, n, dim=16):
    """Groups around centres, with copies, and noise."""
    centres = rng.normal(size=(n // 8, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2)), 1, "x"))
    return rows


def test_against_all_pairs(shipped):
    rows = vectors(np.random.default_rng(5), 300)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vi.near_vectors(shipped.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    found = sum(min(got[i][0], want[i][0]) for i in want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.95 * sum(n for n, _ in want.values())


def test_large_groups_are_compared_in_blocks(shipped, monkeypatch):
    monkeypatch.setattr("weekgrain.llm.blocks.blocked.__defaults__", (7,))
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.1], 1, 1, "x") for i in range(60)]
    found = vi.near_vectors(shipped.createDataFrame(rows, SCHEMA), vi.Index(recall=1.0)).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert got == brute(rows)


def test_odd_rows(shipped):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, 1, "a"), (1, [1.0, 0.0], 1, 1, "a"), (2, [2.0, 0.0], 1, 1, "a"), (3, None, 1, 1, "a"),
        (4, [0.0, 0.0], 1, 1, "a"), (5, [nan, 1.0], 1, 1, "a"), (6, [1.0, None], 1, 1, "a"), (7, [1.0, 0.0], None, 1, "a"),
        (None, [1.0, 0.0], 1, 1, "a"), (8, [inf, 0.0], 1, 1, "a"), (9, [1.0, 0.0, 0.0], 1, 1, "a"), (10, [], 1, 1, "a"),
        (11, [1e-30, 0.0], 1, 1, "a"), (12, [1.0], 1, 1, "a"), (13, [3e38, 0.0], 1, None, None), (14, [1.0, 0.0], 2, 1, "a"),
    ]
    df = shipped.createDataFrame(rows, SCHEMA)
    got = vi.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 14):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    for i in (2, 11, 13):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (4, 1, False)
    assert by[1]["n_links"] == 4 and by[1]["kept"]
    assert (by[None]["n_links"], by[None]["component_id"], by[None]["kept"]) == (0, None, False)
    assert vi.near_vectors(df.where("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=7), st.lists(st.integers(0, 30), min_size=1, max_size=7), st.integers(0, 40))
def test_traversal_visits_cells_in_order(a, b, excess):
    a, b = np.array(a, float), np.array(b, float)
    got = vi.traverse(a, b, excess)
    sums = {i * len(b) + j: x + y for i, x in enumerate(a) for j, y in enumerate(b)}
    assert [sums[c] for c in got] == sorted(sums[c] for c in got)
    assert set(got) == {c for c, s in sums.items() if s <= min(sums.values()) + excess}
    assert heapq.nsmallest(1, sums.values())[0] == sums[got[0]]


def test_query_recall(shipped, sf_dir):
    data = shipped.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"], r["label"]) for r in data])
    got = {r["vec_id"]: r for r in vi.op7(shipped, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())
