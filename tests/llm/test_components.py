import random

from tabulon.llm.components import components, merged


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def graph(rng, nodes, edges):
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]


def table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long").repartition(3)


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_components_and_merging(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(0, 60)]
    for first, more in ((graph(rng, 200, 120), graph(rng, 260, 60)), (chain[::2], chain[1::2]), ([(5, 5)], [(7, 3), (3, 7), (9, 9)]), ([], [(1, 2)]), ([(1, 2)], []),
                        ([(0, k) for k in range(1, 300)], [(299, 400), (400, 500), (-4, 500)])):
        proper = [e for e in first if e[0] != e[1]]
        labels = components(table(spark, first))
        assert found(labels) == brute(proper)
        both = proper + [e for e in more if e[0] != e[1]]
        assert found(merged(labels, table(spark, more))) == brute(both)
