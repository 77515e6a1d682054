import random

from passagemill.llm.components import components
from passagemill.llm.workspace import Workspace


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(30)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {n: root(n) for n in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0
