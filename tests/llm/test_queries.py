from weekgrain.llm import queries


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.NAMES) == list(range(1, 14))
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
