import random

import pytest
from pyspark.sql import functions as F

from annalist.operators.patches import apply_to, compose, current_state, iso_instant


INSTANTS = [
    ("1970-01-02", 86400, 0), ("1970-01-01T00:00:01Z", 1, 0), ("1970-01-01T02:00:00+02:00", 0, 0), ("1970-01-01T00:00:00-05:30", 19800, 0), ("1970-01-01T00:00:00+0100", -3600, 0),
    ("1970-01-01T00:00:00-02", 7200, 0), ("1970-01-01T00:01Z", 60, 0), ("1970-01-01T00:00:00.25Z", 0, 250000000), ("2020-02-29", 1582934400, 0), (" 1970-01-01 ", 0, 0), ("1969-12-31T23:59:59Z", -1, 0),
]
NO_INSTANTS = [None, "", "yesterday", "n/a", "0000-00-00", "2021-02-30", "2021-06-31T00:00:00Z", "2022-13-04T10:00:00Z", "2022-01-01T24:00:00Z", "2022-01-01T10:60Z", "2021-02-29", "2022-1-1", "x" * 10000]


def test_instants(spark):
    texts = [(i, x) for i, x in enumerate([t for t, _, _ in INSTANTS] + NO_INSTANTS)]
    got = {r.n: r.i for r in spark.createDataFrame(texts, "n int, t string").select("n", iso_instant(F.col("t")).alias("i")).collect()}
    for i, (text, seconds, nanos) in enumerate(INSTANTS):
        assert (got[i].seconds, got[i].nanos) == (seconds, nanos), text
    assert all(got[i] is None for i in range(len(INSTANTS), len(texts)))


def brute(rows):
    state = {}
    for key, at, n, gone, value in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2], bool(r[3]), r[4] or "")):
        state.pop(key, None)
        if not gone:
            state[key] = (n, value)
    return {(k, *v) for k, v in state.items()}


SCHEMA = "key string, at long, n long, gone boolean, value string"


@pytest.mark.parametrize("seed", range(2))
def test_feed_in_any_order(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", *map(str, range(20)), None]), r.choice([*range(50), None]), i, r.choice([True, False, False, None]), r.choice(["a", "b", None])) for i in range(500)]
    rows += rows[:60]
    r.shuffle(rows)
    got = current_state(spark.createDataFrame(rows, SCHEMA), "key", "at", "n", "gone", ["n", "value"])
    assert {tuple(x) for x in got.collect()} == brute(rows)


def test_empty_feed_and_base(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert current_state(none, "key", "at", "n", "gone", ["value"]).count() == 0
    base = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "key string, value string")
    feed = spark.createDataFrame([("a", 1, 1, True, None), ("b", 1, 1, False, "new"), ("d", 1, 1, False, None), ("e", 1, 1, True, None)], SCHEMA)
    got = current_state(feed, "key", "at", "n", "gone", ["value"], base)
    assert {tuple(x) for x in got.collect()} == {("b", "new"), ("c", "old"), ("d", None)}


def test_partial_updates_keep_what_they_do_not_name(spark):
    rows = [("a", 1, 1, False, "x", None), ("a", 2, 2, False, None, "y"), ("b", 1, 1, False, "p", "q"), ("b", 2, 2, True, None, None), ("b", 3, 3, False, None, "r"), ("c", 1, 1, False, "k", "k"), ("c", 2, 2, True, None, None)]
    feed = spark.createDataFrame(rows, "key string, at long, n long, gone boolean, u string, v string")
    got = current_state(feed, "key", "at", "n", "gone", ["u", "v"], partial=True)
    assert {tuple(x) for x in got.collect()} == {("a", "x", "y"), ("b", None, "r")}


def test_composition_is_associative(spark):
    rows = [("a", i, i, i % 7 == 0, str(i)) for i in range(1, 30)]
    feed = spark.createDataFrame(rows, SCHEMA)
    whole = compose(feed, "key", "at", "n", "gone", ["value"])
    first, second = (compose(feed.where(w), "key", "at", "n", "gone", ["value"]) for w in ("n < 11", "n >= 11"))
    empty = spark.createDataFrame([], "key string, value string")
    step = apply_to(apply_to(empty, first, "key", ["value"]), second, "key", ["value"])
    assert {tuple(r) for r in step.collect()} == {tuple(r) for r in apply_to(empty, whole, "key", ["value"]).collect()}
