import random

from keystead.llm.graph import components


def roots(spark, links):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    return {r["node"]: r["root"] for r in rows}


def test_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1050)]
    out = roots(spark, chain + star + [(3, 3), (None, 5)])
    assert all(out[i] == 100 for i in range(101, 141)) and all(out[i] == 7 for i in range(1000, 1050))
    assert 3 not in out and 5 not in out


def test_random_graph(spark):
    rng = random.Random(9)
    links = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = roots(spark, links)
    assert all(out.get(n, n) == find(n) for n in parent)


def test_no_links(spark):
    assert roots(spark, []) == {}
