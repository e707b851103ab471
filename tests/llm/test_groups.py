import random

from annalist.llm.groups import link_groups, representatives


def brute(pairs, known):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b and a in known and b in known:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {(x, find(x)) for x in root}


def run(spark, pairs, ids):
    links = spark.createDataFrame(pairs, "left_id long, right_id long").selectExpr("left_id", "right_id", "left_id as node", "1 as label")
    known = spark.createDataFrame([(i,) for i in ids], "mention_id long")
    return {tuple(r) for r in link_groups(links, "left_id", "right_id", known, "mention_id").collect()}


def test_chains_stars_and_noise(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(300 + i, 299) for i in range(1, 120)]
    loose = [(r.randint(500, 560), r.randint(500, 560)) for _ in range(25)]
    noise = [(None, 1), (1, None), (None, None), (1, 1), (1, 9999), (9999, 2)]
    pairs = chain + star + loose + noise + chain[:9] + [(b, a) for a, b in star[:9]]
    r.shuffle(pairs)
    ids = [*range(0, 600), 5, 5, None]
    assert run(spark, pairs, ids) == brute(pairs, set(ids))


def test_no_links(spark):
    assert run(spark, [], [1]) == set() and run(spark, [(1, None), (2, 2)], [1, 2]) == set()
    one = representatives(spark.createDataFrame([(3,), (None,), (3,)], "m long"), "m", spark.createDataFrame([], "a long, b long"), "a", "b")
    assert [tuple(x) for x in one.collect()] == [(3, 3)]


def test_a_hub_links_a_third_of_all(spark):
    """One mention linked with very many, and chains that hang on it: joins on its label are split, and all have one root."""
    pairs = [(5, 1000 + i) for i in range(6000)] + [(1000 + i, 20000 + i) for i in range(0, 6000, 3)] + [(30000 + 2 * i, 30001 + 2 * i) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
    try:
        got = run(spark, pairs, sorted({x for p in pairs for x in p}))
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    assert len(got) == 1 + 6000 + 2000 + 8000 and {label for node, label in got if node < 30000} == {5}
    assert all(label == node - node % 2 for node, label in got if node >= 30000)
