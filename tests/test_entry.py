import __spark_entry__ as entry
from annalist.operators.facts import FactQuery, best, page
from annalist.streaming import feeds, sinks


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 90
    assert {f"p{n}_found" for n in (1, 2, 6)} <= set(queries)


def test_pages_and_questions(spark, small):
    facts = spark.read.parquet(f"{small}/facts.parquet")
    assert page(facts, FactQuery(limit=0)).count() == 0
    head = page(facts, FactQuery(limit=500)).collect()
    assert len(head) == 64 and head[0].truncated and head[0].matched == facts.count()
    assert best(facts, FactQuery(subject=-1)).count() == 0
    assert FactQuery().describe() == "everything limit=16" and FactQuery(subject=3, limit=2).during(1, 2).describe() == "subject=3 day_from=1 day_to=2 limit=2"


def test_followed_feed(spark, tmp_path):
    schema = "key string, at long, n long, gone boolean, value string"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    steps = [[("a", 1, 1, False, "x"), ("b", 1, 2, False, "y")], [("a", 0, 3, False, "late"), ("b", 5, 4, True, None)], [("b", 4, 5, False, "late"), ("c", 1, 6, None, "z")]]
    for version, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.follow(stream, out, f"{tmp_path}/checkpoint", "key", "at", "n", "gone", ["value"]).trigger(availableNow=True).start().awaitTermination()
        state = {(r.key, r.value) for r in feeds.latest(spark, out, version, "gone").collect()}
    assert state == {("a", "x"), ("c", "z")}


def test_catalogue_rolls_into_parts(spark, tmp_path):
    """Two batches, the second run again: every row is there once, parts hold three rows each."""
    source, base = f"{tmp_path}/in", f"file://{tmp_path}/catalogue"
    for version, rows in enumerate([[(5, "e"), (1, "a")], [(2, "b"), (9, "i"), (3, "c")]]):
        spark.createDataFrame(rows, "entry_id long, title string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("entry_id long, title string").parquet(source)
        checkpoint = f"{tmp_path}/checkpoint"
        sinks.append_catalogue(stream, base, checkpoint, ["entry_id"], part_rows=3).trigger(availableNow=True).start().awaitTermination()
        if version:
            # As after a crash between the write and the commit.
            (tmp_path / "checkpoint/commits/1").unlink()
            (tmp_path / "checkpoint/commits/.1.crc").unlink(missing_ok=True)
            sinks.append_catalogue(stream, base, checkpoint, ["entry_id"], part_rows=3).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.place, r.entry_id, r.part, r.batch) for r in sinks.catalogue(spark, base).collect())
    assert got == [(1, 1, 0, 0), (2, 5, 0, 0), (3, 2, 0, 1), (4, 3, 1, 1), (5, 9, 1, 1)]
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (5, 4)], "place long, cluster long")
    local, lost = sinks.local_clusters(rows, 3)
    assert sorted((r.place, r.part, r.local_cluster) for r in local.collect()) == [(1, 0, 1), (2, 0, 1), (3, 0, 0), (4, 1, 0), (5, 1, 1)] and lost.first().lost == 1
