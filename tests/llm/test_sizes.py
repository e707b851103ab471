import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import tokens
from annalist.llm.mixing import Mixture, draw, permuted, quotas
from annalist.llm.packing import fill, filling, pack
from annalist.llm.tokens import FOLDER, _counter, token_count

EXACT = "byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("seed", range(4))
def test_fill(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 101, 800) if seed else np.array([40] * 30 + [60] * 30)
    place = fill(sizes, 100)
    load = np.bincount(place, weights=sizes)
    assert (place >= 0).all() and load.max() <= 100
    assert len(load) <= np.ceil(sizes.sum() / 100) * 1.12 + 1
    large = np.bincount(place, weights=3 * sizes > 100)
    assert large.max() <= 2


def test_pack(spark):
    rows = [(i, (i * 37) % 90) for i in range(300)] + [(1000, 250), (1001, 200), (1002, None), (5, 5), (None, 7)]
    df = spark.createDataFrame(rows, "id long, tokens long").selectExpr("*", "'x' as bin_name", "1 as item")
    out = pack(df, "id", "tokens", [("big", 100), ("huge", 1000)], shard_items=100).toPandas()
    for name, most in (("big", 100), ("huge", 1000)):
        one = out[out.bin_name == name]
        assert one.groupby("container")["size"].sum().max() <= most
        assert one["size"].sum() == sum(s or 0 for _, s in rows) and one.item.nunique() == 303
        assert set(one[one.pieces > 1].item) == {i for i, s in rows if i and s and s > most}
    assert out[(out.bin_name == "big") & (out.item == 1000)].sort_values("piece")[["begin", "size"]].values.tolist() == [[0, 100], [100, 100], [200, 50]]
    assert pack(df.limit(0), "id", "tokens", [("big", 100)]).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "tokens", [("none", 0)])


def test_tokens_of_whole_texts(spark, monkeypatch):
    count = _counter(f"{FOLDER}/{EXACT}")
    # A text is the sum of its words, however long, and a word of any length is one word.
    mixed = "Don't  word and\n\n  sentence, 12345 éà\t\t x" * 400 + "  \n"
    whole = count(mixed)
    monkeypatch.setattr(tokens, "PIECE", 37)
    assert count(mixed) == whole
    monkeypatch.undo()
    assert count("ab" * 40_000 + " end") == count("ab" * 40_000) + count(" end") and count(" " * 600_000) > 0
    got = spark.createDataFrame([("",), (None,), ("Hello world",), ("a" * 300000,)], "t string").select(token_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got][:3] == [0, 0, 2] and got[3].n > 1000


def test_permutations():
    for n in (1, 2, 7, 64, 1000):
        out = permuted(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(out) == list(range(n))
    assert permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 6)).tolist() != out.tolist()


def test_copies_fill_containers_like_others(spark):
    """A third of all rows are copies of one: they spread over the shards, the same in every run."""
    rows = spark.createDataFrame([(7, 3)] * 9000 + [(i, i % 5 + 1) for i in range(1000, 1600)], "id long, tokens long")
    first, second = (pack(rows.repartition(n), "id", "tokens", [("box", 10)], shard_items=500).groupBy("container").agg(F.sum("size").alias("s"), F.count("*").alias("n")) for n in (2, 7))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) and first.agg(F.max("s")).first()[0] <= 10
    report = filling(pack(rows, "id", "tokens", [("box", 10)]), [("box", 10)]).first()
    assert report.tokens == 27000 + sum(i % 5 + 1 for i in range(1000, 1600)) and report.containers >= report.least_containers and report.fill > 0.9


def test_quotas_and_draws():
    share, cap = np.array([0.5, 0.3, 0.2]), np.array([10.0, 1000.0, 1000.0])
    q = quotas(share, cap, 100)
    assert q.tolist() == [10.0, 54.0, 36.0]
    counts = draw(np.arange(7), 7, 90, np.array([10, 0, 0]), np.array([0.0, 54.0, 36.0]), 1)
    assert counts.sum() == 100 and counts[:, 0].sum() == 10 and counts[:, 0].max() <= 2
    assert (draw(np.array([3, 5]), 7, 90, np.array([10, 0, 0]), np.array([0.0, 54.0, 36.0]), 1) == counts[[3, 5]]).all()
    assert quotas(share, np.array([1.0, 1.0, 1.0]), 100).sum() == 3 and draw(np.arange(3), 3, 0, np.zeros(2), np.zeros(2), 1).sum() == 0


@pytest.mark.parametrize("shard_blocks", [4, 1024])
def test_draws_beyond_a_cap_go_to_others(spark, shard_blocks):
    """Caps just above the shares: chance draws more than a source has, and what is beyond goes elsewhere."""
    docs = spark.createDataFrame([(i, s, 10) for k, s in enumerate("abcd") for i in range(k * 1000, k * 1000 + (101 if s != "d" else 97))], "id long, source string, tokens long")
    targets = spark.createDataFrame([(s, 0.25, 1) for s in "abcd"], "source string, share double, cap int")
    mix = Mixture(docs, "id", "source", "tokens", targets, "source", "share", "cap", block=10, shard_blocks=shard_blocks)
    slots = mix.slots.toPandas()
    assert len(slots) == 400 == mix.slots_drawn.sum() and not slots.duplicated(["source", "slot"]).any() and not slots.duplicated(["source", "block"]).any()
    assert slots.groupby("source").slot.agg(["min", "max"]).assign(n=slots.groupby("source").size()).eval("min == 0 and max == n - 1").all()
    assert {r.source: r.short for r in mix.report().collect()} == {"a": False, "b": False, "c": False, "d": True}


def test_mixture(spark):
    rows = [(i, "hot", 100) for i in range(200)] + [(1000 + i, "small", 50) for i in range(10)] + [(2000, None, 500), (2001, "other", 500), (2002, "small", None), (3000, "hot", 7000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long").selectExpr("*", "0 as block", "0 as id")
    targets = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.3, 2), ("absent", 0.2, 9), (None, 0.1, 1)], "source string, share double, cap int")
    mix = Mixture(docs, "doc_id", "source", "tokens", targets, "source", "share", "cap", block=64)
    report = {r.source: r for r in mix.report().collect()}
    assert {s for s, r in report.items() if r.short} == {"small", "absent"}
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert report["small"].mixed_tokens <= 1000 and report["absent"].mixed_tokens == 0 and report["hot"].source_tokens == 27000
    used = mix.used().toPandas()
    assert used[used.source == "hot"].repeats.max() <= 1 and used[used.source == "small"].repeats.max() <= 2
    content = mix.content().toPandas()
    assert content.tokens.sum() == used.tokens.sum() and (content.groupby(["shard", "drawn", "pos", "source"]).tokens.sum() <= 64).all()
    none = Mixture(docs.limit(0), "doc_id", "source", "tokens", targets, "source", "share", "cap")
    assert none.content().count() == 0 and none.report().count() == 3
    with pytest.raises(ValueError):
        Mixture(docs, "doc_id", "source", "tokens", targets.union(targets), "source", "share", "cap")
