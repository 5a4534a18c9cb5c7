"""Connected components of random graphs."""

import numpy as np

from sparkdraft.llm.components import connected


def test_random_graph_and_chain(spark):
    random = np.random.RandomState(3)
    edges = [tuple(map(int, e)) for e in random.randint(0, 120, (70, 2))] + [(i, i + 1) for i in range(500, 540)] + [(900, i) for i in range(901, 960)] + [(7, 7), (3, 4), (4, 3)]
    group = {n: n for e in edges if e[0] != e[1] for n in e}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            group[y] = x
    got = dict(map(tuple, connected(spark, spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {n: top(n) for n in group}


def test_no_edges(spark):
    assert connected(spark, spark.createDataFrame([], "u long, v long")).count() == 0
