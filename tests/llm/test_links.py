import random

from brute import Union

from chronofold.llm.links import components


def test_components_match_union_find(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    edges = [*chain, *star, *loose, (7, 7), (9, 8), (8, 9), (9, 8)]
    union = Union({x for e in edges for x in e})
    for a, b in edges:
        union.join(a, b)
    frame = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    want = {x: union.find(x) for x in union.up if x != 7}
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
