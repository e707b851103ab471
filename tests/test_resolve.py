import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import facts as ask
from annalist.operators import folds, order, places, resolve
from annalist.operators.catalogue import CatalogueQuery, browse
from annalist.operators.grounding import Crowded, synthesise
from annalist.sources import delimited, textlines
from annalist.storage import shared_dir


def test_places_in_an_order(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(500)] + [(None, None)], "a int, b int")
    got = order.numbered(rows.repartition(5), [F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first()]).collect()
    want = sorted(((i % 7, i) for i in range(500)))
    assert {r.place: (r.a, r.b) for r in got} == {1: (None, None)} | {n + 2: w for n, w in enumerate(want)}
    assert order.numbered(rows.limit(0), [F.col("a")]).count() == 0
    run = order.running(rows.where("a is not null"), "a", "b", F.lit(1), "n", chunk=64).collect()
    assert all(r.n == sum(1 for i in range(r.b) if i % 7 == r.a) for r in run)
    same = order.compared(rows, rows, [F.col("a"), F.col("b")], ["a", "b"]).first()
    other = order.compared(rows, rows.where("b is null or b <> 14"), [F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first()], ["a", "b"]).first()
    assert (same.match, same.first_place) == (True, None) and (other.match, other.first_place) == (False, 4)


HANDLES = [
    (1, "Canal Office of Wexholm", "https://doi.org/10.5/AB"), (2, "Office, Canal", "10.5/ab"), (3, "Canal Office Wexholm", None), (4, "COW", ""), (5, None, "http://x.example/p?utm_source=q"), (6, "Tolls", "x.example/p/"), (7, "Tolls", None),
]


def test_resolution(spark):
    rows = spark.createDataFrame(HANDLES, "id long, name string, reference string").selectExpr("*", "id as label", "name as key")
    plain = resolve.Resolution(rows)
    assert {(r.id, r.label) for r in plain.labels.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)}
    proposed = {(r.left, r.right): (r.score, r.evidence) for r in plain.proposals.collect()}
    assert proposed == {(1, 3): (49152, 2), (2, 3): (43690, 2), (6, 7): (65536, 2), (3, 4): (36045, 3), (1, 4): (36045, 3)}
    merged = resolve.Resolution(rows, auto_merge=49152)
    assert {r.label for r in merged.labels.where("id in (1, 2, 3)").collect()} == {1} and {(r.left, r.right) for r in merged.proposals.collect()} >= {(3, 4)}
    with pytest.raises(resolve.Duplicates):
        resolve.Resolution(rows.unionByName(rows.limit(1)))
    assert resolve.Resolution(rows.limit(0)).labels.count() == 0


def test_names_are_compared_only_for_what_is_asked(spark, monkeypatch):
    asked, plain = [], resolve.similar_pairs
    monkeypatch.setattr(resolve, "similar_pairs", lambda rows, id, name, least: asked.append(least) or plain(rows, id, name, least))
    rows = spark.createDataFrame(HANDLES, "id long, name string, reference string")
    found = resolve.Resolution(rows)
    assert found.labels.count() == 7 and asked == []
    assert found.proposals.count() == 5 and asked == [resolve.PROPOSE]
    assert resolve.Resolution(rows, auto_merge=49152).labels.count() == 7 and asked == [resolve.PROPOSE, 49152]
    # What scores as just proposed merges abbreviations too.
    assert {r.label for r in resolve.Resolution(rows, auto_merge=resolve.PROPOSE).labels.where("id in (1, 2, 3, 4)").collect()} == {1}


def test_witnesses_and_agreements(spark):
    r = random.Random(4)
    refs = {i: r.choice([None, "a.example/x", "http://www.a.example/x/", "b.example", ""]) for i in range(12)}
    edges = [(10, 11), (3, 99), (8, 10), (8, 8)]
    told = [(r.randrange(14), r.randrange(6)) for _ in range(40)]
    key = {None: None, "": None, "a.example/x": "a", "http://www.a.example/x/": "a", "b.example": "b"}
    root = {i: i for i in range(12)}
    while True:
        links = [(a, b) for a in root for b in root if key[refs[a]] and key[refs[a]] == key[refs[b]]] + [e for e in edges if e[1] in root]
        after = {i: min([root[i]] + [root[b] for a, b in links if a == i] + [root[a] for a, b in links if b == i]) for i in root}
        if after == root:
            break
        root = after
    claims = {}
    for s, c in told:
        if s in root:
            claims.setdefault(c, set()).add(s)
    want = {s: max([len({root[x] for x in who}) - 1 for who in claims.values() if s in who], default=0) for s in root}
    sources = spark.createDataFrame([(i, ref) for i, ref in refs.items()], "source_id long, ref string")
    roots = resolve.witnesses(sources, "ref", spark.createDataFrame(edges, "derived long, original long"))
    assert {x.source_id: x.witness for x in roots.collect()} == root
    by_source, by_claim = resolve.agreements(spark.createDataFrame(told + [(1, None)], "source_id long, claim long"), roots)
    assert {x.source_id: x.agreements for x in by_source.collect()} == want
    assert {x.claim: (x.sources, x.inflated) for x in by_claim.collect()} == {c: (len(who), len({root[x] for x in who}) == 1 and len(who) > 1) for c, who in claims.items()}
    with pytest.raises(resolve.Duplicates):
        resolve.witnesses(sources.unionByName(sources), "ref", spark.createDataFrame([], "derived long, original long"))


def test_places(spark):
    gazetteer = spark.createDataFrame([(1, 7, 65536, -65536, -10, 20), (2, 7, 0, 0, 0, 0), (3, 8, None, 5, None, 9)], "record long, place long, lat_raw long, lon_raw long, min_year int, max_year int")
    ids = spark.createDataFrame([(7,), (8,), (9,)], "place long")
    got = {r.place: r for r in places.resolved(ids, gazetteer).withColumn("there", places.exists_in_year(F.lit(30))).collect()}
    assert set(got) == {7, 8} and (got[7].x, got[7].z, got[7].located, got[7].dated, got[7].there) == (-65536, 65536, True, True, False)
    assert (got[8].located, got[8].dated, got[8].min_year, got[8].there) == (False, False, 0, True)
    links = spark.createDataFrame([(1, n) for n in range(50, 0, -1)] + [(2, 1)], "place long, neighbour long")
    assert sorted((r.place, r.neighbour, r.total) for r in places.neighbours(links, 3).collect()) == [(1, 1, 50), (1, 2, 50), (1, 3, 50), (2, 1, 1)]


def test_catalogue_questions(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1600, 1, 0, "Salt"), (2, "a", 1500, 0, 3, 0, None), (3, "b", 1500, 1650, 5, 7, "salt")], "entry_id long, holder string, year_from int, year_to int, flags long, lang_tag int, title string")
    ask_ = lambda **q: {r.entry_id for r in rows.where(CatalogueQuery(**q).condition()).collect()}
    assert ask_() == {1, 2, 3} and ask_(year_to=1700) == {2, 3} and ask_(year_from=1600) == {3} and ask_(language=0) == {1, 2} and ask_(flags=1, without=4) == {1, 2} and ask_(title="Salt") == {1}
    assert [(r.entry_id, r.matched, r.total) for r in browse(rows, CatalogueQuery(holder="a"), 1).collect()] == [(1, 2, 3)]


def test_records_of_files(spark):
    text = 'id,t\n1,"two\nlines, ""quoted"""\n\n2,plain\n3,"open\nto the end'
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))] + [("g", 0, "a")], "file string, line long, text string")
    got = {(r.file, r.record): r.text for r in delimited.logical_records(lines, "file", "line", "text").collect()}
    assert got == {("f", 0): "id,t", ("f", 1): '1,"two\nlines, ""quoted"""', ("f", 4): "2,plain", ("f", 5): '3,"open\nto the end', ("g", 0): "a"}


def test_lines_and_folds(spark):
    docs = spark.createDataFrame([(1, "é\n\nlast"), (2, ""), (3, None), (4, "one")], "d long, t string")
    lines = textlines.split_lines(docs, "d", "t")
    table = textlines.offsets(lines)
    assert {(r.doc, r.line): (r.begin, r.size) for r in table.collect()} == {(1, 0): (0, 2), (1, 1): (2, 0), (1, 2): (2, 4), (4, 0): (0, 3)}
    sizes = table.groupBy("doc").agg(F.count("*").alias("lines"), F.sum("size").alias("bytes"))
    assert textlines.refused(table, sizes).count() == 0 and textlines.line_at(lines, 1, 2).first().text == "last" and textlines.line_at(lines, 1, 3).count() == 0
    bad = textlines.refused(table.withColumn("begin", 5 - F.col("begin")), sizes).collect()
    assert {r.doc: r.reason for r in bad} == {1: "offsets out of order", 4: "offsets out of order"}

    def fnv(words):
        h = 2166136261
        for w in words:
            h = (h ^ (w & 0xFFFFFFFF)) * 16777619 & 0xFFFFFFFF
        return h

    assert docs.where("d = 1").select(folds.fold_text(F.col("t")).alias("f")).first().f == fnv([*"é\n\nlast".encode(), 3, 8])
    names = spark.createDataFrame([(9, "b"), (3, "a")], "id long, name string")
    assert folds.fold_vocabulary(names).first().fold == fnv([3, 97, 1, 9, 98, 1])


def test_encoding_and_fusion(spark):
    row = spark.createDataFrame([(1, 1202, None, -5, 3, 4, 65536, 0), (2**33, 1, 1, 1, 1, 1, 1, 1)], "subject long, predicate long, object_ref long, from_day int, to_day int, source_ref long, confidence_raw long, locus long")
    assert [r.w for r in row.select(ask.encoded_fact().alias("w")).collect()] == [[1, 1202, 0, 2**32 - 5, 3, 4, 65536, 0], None]
    told = spark.createDataFrame([(1, 1202, 5, s, c) for s, c in ((1, 32768), (2, 32768), (3, 32768), (3, 10), (4, None), (5, 70000))], "subject long, predicate long, object_ref long, source_ref long, confidence_raw long")
    assert [(r.fused, r.sources) for r in ask.fused(told, 1202).collect()] == [(65536 - 8192, 3)]


def test_crowded_passages_fail_the_batch(spark):
    claims = spark.createDataFrame([(1, "t", "t", "t", "p", "t", 0, 0, 1)] * 65, "d long, passage string, quotation string, subject string, predicate string, object string, from_day int, to_day int, confidence_raw long")
    with pytest.raises(Crowded):
        synthesise(claims, "d")
    assert synthesise(claims.limit(64), "d").where("outcome = 'admitted'").count() == 64


def test_clusters_need_a_shared_folder(spark):
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="shared|share"):
        shared_dir(Session())
    assert shared_dir(spark)


def test_texts_of_all_lengths_are_folded_side_by_side(spark):
    r = random.Random(9)
    texts = {i: "".join(r.choices("aé\n€x ", k=r.choice([1, 7, 300]))) for i in range(60)} | {60: "long line\n" * 20_000, 61: "ab" * 100_001}

    def fnv(words):
        h = 2166136261
        for w in words:
            h = (h ^ w) * 16777619 & 0xFFFFFFFF
        return h

    docs = spark.createDataFrame(list(texts.items()), "d int, t string").coalesce(1)
    got = {x.d: x.f for x in docs.select("d", folds.fold_text(F.col("t")).alias("f")).collect()}
    assert got == {d: fnv([*t.encode(), t.count("\n") + 1, len(t.encode())]) for d, t in texts.items()}
    assert list(folds._folded([])) == []
