import random
from collections import Counter

from taulab.llm.components import connected_components, extended
from taulab.llm.workspace import Workspace, fresh


def smallest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in list(root)}


def saved(spark, work, edges):
    return work.save(spark.createDataFrame(edges, "a long, b long"), "given")


def test_components_and_further_edges(spark):
    r = random.Random(2)
    graphs = [
        [],
        [(1, 1), (2, 2), (2, 2)],
        [(k, k + 1) for k in range(40)],
        [(0, k) for k in range(1, 50)] + [(100, 49), (None, 3), (4, None)],
        [(r.randrange(60), r.randrange(60)) for _ in range(45)],
    ]
    for edges in graphs:
        work = Workspace(spark, "components")
        found = connected_components(saved(spark, work, edges), work)
        assert Counter((x.node, x.component) for x in found.collect()) == Counter(smallest(edges).items())
        more = [(r.randrange(80), r.randrange(80)) for _ in range(12)] + [(None, 1)]
        for extra in (more, []):
            out = extended(found, saved(spark, work, extra), work)
            assert Counter((x.node, x.component) for x in out.collect()) == Counter(smallest(edges + extra).items())


def test_names_that_a_table_does_not_have(spark):
    df = spark.createDataFrame([(1, 2)], "_gone int, `_GONE_` int")
    assert fresh(df, "gone") == "_gone__" and fresh(df, "id") == "_id"
