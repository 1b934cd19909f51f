import random

from brindle.llm.components import components


def brute(links):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        if u != v:
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in root)


def run(spark, links):
    return sorted((r["node"], r["root"]) for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect())


def test_shapes(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(150)]
    names = rng.sample(range(1000, 5000), 151)
    mixed = [(names[a], names[b]) if rng.random() < 0.5 else (names[b], names[a]) for a, b in path]
    star = [(9000, 9001 + i) for i in range(300)] + [(8000 + i, 9500) for i in range(50)]
    sparse = [(rng.randrange(20000, 20400), rng.randrange(20000, 20400)) for _ in range(220)]
    links = [(-i, -j) for i, j in path] + mixed + star + sparse + [(7, 7), (9000, 9001)] * 2
    assert run(spark, links) == brute(links)


def test_a_long_chain(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 10_001)
    links = list(zip(names, names[1:], strict=False))
    assert run(spark, links) == sorted((x, min(names)) for x in names)


def test_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, 3)]) == []
