import random

import pytest

from annalist.operators.intervals import MergedIntervals


def brute(rows):
    gaps, periods = set(), set()
    for key in {k for k, _, _ in rows if k is not None}:
        runs = sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None and b >= a)
        if not runs:
            continue
        start, stop = runs[0]
        for a, b in runs[1:]:
            if a > stop + 1:
                periods.add((key, start, stop))
                gaps.add((key, stop + 1, a - 1))
                start, stop = a, b
            stop = max(stop, b)
        periods.add((key, start, stop))
    return gaps, periods


def run(spark, rows, schema="subject long, from_day int, to_day int"):
    merged = MergedIntervals(spark.createDataFrame(rows, schema), "subject", "from_day", "to_day")
    return {tuple(r) for r in merged.gaps().collect()}, {tuple(r) for r in merged.periods().collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_intervals_with_one_hot_key(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(600):
        key = 1 if r.random() < 0.4 else r.randint(2, 12)
        a = r.randint(-3000, 3000)
        b = a + r.choice([0, 1, 5, 40, 900 if r.random() < 0.05 else 3])
        rows.append((r.choice([key] * 20 + [None]), r.choice([a] * 20 + [None]), r.choice([b] * 20 + [a - 5])))
    assert run(spark, rows + rows[:50]) == brute(rows)


def test_long_interval_swallows_later_partitions(spark):
    rows = [(7, 0, 5000)] + [(7, i * 10, i * 10 + 3) for i in range(400)] + [(7, 6000, 6001), (7, 5001, 5001)]
    gaps, periods = run(spark, rows)
    assert gaps == {(7, 5002, 5999)} and periods == {(7, 0, 5001), (7, 6000, 6001)}


def test_touching_nested_equal_and_empty(spark):
    assert run(spark, [(1, 1, 2), (1, 3, 4), (1, 3, 4), (1, 1, 4)]) == (set(), {(1, 1, 4)})
    assert run(spark, []) == (set(), set())
    assert run(spark, [(None, 1, 2), (1, None, 2), (1, 3, 2)]) == (set(), set())


def test_text_keys_and_clashing_extra_columns(spark):
    rows = [("ä", 1, 2, "x", 0), ("ä", 9, 9, None, 1), ("z", 0, 0, "", 2)]
    df = spark.createDataFrame(rows, "Subject string, from_day int, to_day int, start string, part int").toDF("Subject", "from_day", "to_day", "start", "part")
    merged = MergedIntervals(df, "Subject", "from_day", "to_day")
    assert [tuple(r) for r in merged.gaps().collect()] == [("ä", 3, 8)]
    twice = df.select("Subject", "from_day", "to_day", "part", "part")
    assert MergedIntervals(twice, "Subject", "from_day", "to_day").periods().count() == 3
