"""Components against union-find on random graphs, long paths and stars."""

import random

from creditlake.llm.components import components


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(up)}


def test_components(spark):
    rnd = random.Random(1)
    cases = [[(rnd.randrange(300), rnd.randrange(300)) for _ in range(n)] for n in (1, 40, 150)]
    cases.append([(i, i + 1) for i in range(70)] + [(500, i) for i in range(501, 900)] + [(7, 7), (1000, 1000)])
    for edges in cases:
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in got} == union_find(edges) and len(got) == len(union_find(edges))


def test_empty_and_null(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    got = components(spark.createDataFrame([("x", None), ("b", "a")], "a string, b string")).collect()
    assert {r.node: r.component for r in got} == {"a": "a", "b": "a"}
