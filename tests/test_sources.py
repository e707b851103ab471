import struct

import pytest
from pyspark.sql import functions as F

from annalist.operators import raster
from annalist.operators.components import components
from annalist.operators.holdings import holdings_clusters
from annalist.operators.setjoin import abbreviations, similar_pairs
from annalist.sources import heights, markdown, oai, rdf, research, tei
from annalist.sources.files import kind_of, read_tree
from annalist.sources.image import STATUS, Image, ImageRefused, part_path, parts, union_section, write_image
from annalist.storage import Workspace

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On Bridges</title><author>A. Mason</author><editor>B. Clerk</editor></titleStmt>
<sourceDesc><title>WRONG</title></sourceDesc></fileDesc><refsDecl><cRefPattern n="section"/><cRefPattern n="book"/></refsDecl></teiHeader><text><body>
<div type="edition" xml:lang="lat" n="urn:cts:x:y.z"><div type="textpart" n="1"><div type="textpart" n="2"><p>First &amp; <placeName key="tgn,1">Roma</placeName> <date when="1863-05">May</date></p></div>
<!-- <div type="textpart" n="9"> --><div n="10A" type="textpart"><p>Odd <date from="1863" to="1865" calendar="#j">x</date></p></div></div></div></body></text></TEI>"""
REPORT = """# Tolls of the upper river

*Third survey, written 1999-12-30 by the canal office*

## Findings

- [S4] Barges paid by the yard.
- [S7] [S11] [S4] Salt went free on feast days.
- An opinion without a source.

## Sources

- [S4] Toll rolls (part two) — <https://rolls.example/7?p=2> (openalex) ✓
- [S7] Letter of a skipper — <https://letters.example/a> (stackexchange) ?
- [S8] ~~https://gone.example/x~~ (timeout)

## Remarks

- [S7] out of scope
"""
NOTES = "# Bridges 1834-05-06\n\n| `BRD-017` | stone, two arches |\n| BRD-018 | timber, beside BRD-017 |\n\n## Repairs\n\nSee BRD-017, BRD-404, ISO-800 and Q-BRD-017. [^3]\n```\nBRD-017\n```\n\n[^3]: by the guild, like BRD-018\n## Dues\n[^3] [^4]\n[^3]: none\n| BRD-017 | once more |\n"
RDF = """<rdf:RDF><pgterms:ebook rdf:about="ebooks/1"><dcterms:issued>1971-12-01</dcterms:issued><dcterms:title>A Title</dcterms:title><dcterms:creator><pgterms:agent><pgterms:name>One</pgterms:name><pgterms:birthdate>-484</pgterms:birthdate>
<pgterms:deathdate>-430</pgterms:deathdate></pgterms:agent></dcterms:creator><dcterms:creator><pgterms:name>Two</pgterms:name><pgterms:birthdate>1743</pgterms:birthdate></dcterms:creator><marcrel:edt><pgterms:deathdate>1916</pgterms:deathdate></marcrel:edt><dcterms:language><rdf:value>en</rdf:value></dcterms:language></pgterms:ebook></rdf:RDF>"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, body in {"a/work.xml": TEI, "b/report.md": REPORT, "b/notes.md": NOTES, "skip/x.md": "no", "b/other.txt": "no"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(body)
    return str(root)


def test_tree_and_kinds(spark, tree):
    got = read_tree(spark, tree, "corpus", ("skip",)).select("canonical", kind_of(F.col("body")).alias("kind")).collect()
    assert {tuple(r) for r in got} == {("corpus/a/work.xml", "tei"), ("corpus/b/report.md", "report"), ("corpus/b/notes.md", "markdown")}


def test_tei(spark, tree):
    works = tei.read_works(read_tree(spark, tree, glob="*.xml")).cache()
    w = works.first()
    assert (w.urn, w.title, w.author, w.editor, w.language, w.scheme) == ("urn:cts:x:y.z", "On Bridges", "A. Mason", "B. Clerk", "lat", "book/section")
    by = {r.path: (r.addressable, r.leaf, r.text) for r in tei.passages(works).collect()}
    assert by == {"1.2": (True, True, "First & Roma May"), "1.10A": (False, True, "Odd x"), "1": (True, False, None)}
    seen = {(r.kind, r.key, r.name, r.to_day - r.from_day if r.from_day is not None else None) for r in tei.mentions(works).collect()}
    assert seen == {("place", "tgn,1", "Roma", None), ("date", None, "May", 30)}
    assert tei.twins(works.union(works)).count() == 1
    made = tei.facts(works).collect()
    assert sorted(r.predicate for r in made) == [1201, 1202, 1203, 1205, 1205, 1206, 1207, 1208, 1210]
    dated = next(r for r in made if r.predicate == 1210)
    assert dated.object == dated.subject and dated.locus == "1.2" and dated.to_day - dated.from_day == 30
    both = spark.createDataFrame([("a", TEI), ("b", TEI)], "canonical string, body string")
    with pytest.raises(tei.TwinWorks, match="urn:cts:x:y.z"):
        tei.ingest(both, Workspace(spark, "twins"))
    cut = tei.passages(tei.read_works(both.limit(1), most_text=5)).where("cut").first()
    assert cut.text == "First"


def test_research(spark, tree):
    reports = read_tree(spark, tree, glob="report.md").select(F.col("canonical").alias("doc"), "body")
    t = research.tally(reports).first()
    assert (t.findings, t.orphans, t.sources, t.unreadable, t.reachable, t.dated) == (2, 1, 3, 1, 1, 1)
    assert {(r.tag, r.confidence_raw) for r in research.rests_on(reports).where("not orphan").collect()} == {("S4", 52429), ("S7", 26214)}
    h = research.heads(reports).first()
    assert (h.topic, h.to_day - h.from_day) == ("Tolls of the upper river", 364)
    assert {r.predicate: r["count"] for r in research.facts(reports).groupBy("predicate").count().collect()} == {1101: 2, 1102: 3, 1103: 2, 1104: 3, 1002: 3, 1106: 1, 1105: 1}


def test_markdown(spark):
    docs = spark.createDataFrame([("a", NOTES), ("b", "BRD-018 and [^9]"), ("c", "")], "doc string, body string")
    scanned = markdown.lines(docs)
    found = markdown.resolve(markdown.references(scanned)).cache()
    r = markdown.report(docs, scanned, found).first()
    assert (r.documents, r.definitions, r.duplicates, r.dangling, r.unknown_scheme, r.first_dangling, r.first_duplicate) == (3, 2, 1, 1, 1, "BRD-404", "BRD-017")
    assert (r.footnotes, r.footnote_citations, r.dangling_footnotes, r.footnote_noise, r.dated) == (2, 3, 1, 1, 1)
    facts = markdown.facts(found).groupBy("predicate").count().collect()
    assert {x.predicate: x["count"] for x in facts} == {1001: 4, 1002: 5, 1003: 4}
    d = {x.name: (x.defined_in, x.citations, x.documents) for x in markdown.definitions(found).collect()}
    assert d["BRD-017"] == ("a", 2, 1) and d["BRD-018"] == ("a", 1, 1)


def test_rdf(spark):
    rows = spark.createDataFrame([("x", RDF), ("y", "<a/>"), ("z", None)], "canonical string, body string")
    got = {r.canonical: r for r in rdf.read_catalogue(rows).collect()}
    x = got["x"]
    assert (x.work, x.title, x.creator, x.language, x.born, x.died, x.undated) == ("ebooks/1", "A Title", "One", "en", -484, -430, False)
    assert got["y"].undated and got["z"].title is None


def page(records, token):
    body = "".join(f'<record><header{" status=\'deleted\'" if gone else ""}><identifier>{i}</identifier><datestamp>2020-01-0{n}</datestamp></header><metadata><dc:title>T{i}</dc:title><dc:identifier>{a}</dc:identifier></metadata></record>' for n, (i, gone, a) in enumerate(records, 1))
    return f"<OAI-PMH><ListRecords>{body}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"


PAGES = {"": page([("r1", False, "x"), ("r2", True, "http://a/b")], "t1"), "t1": page([("r3", False, "doi:10/1")], "t2"), "t2": page([], "t2")}


class Scripted:
    slept: list = []

    def get(self, url):
        token = url.partition("resumptionToken=")[2]
        if token == "t1" and not Scripted.slept:
            return oai.Response(503, "", 999)
        return oai.Response(200, PAGES[token])

    def sleep(self, seconds):
        Scripted.slept.append(seconds)


def test_oai_pages():
    got = list(oai.harvest(Scripted(), "http://x"))
    assert [len(r) for r, _ in got] == [2, 1, 0] and Scripted.slept == [120]
    assert got[0][0][0][7] == "r1" and got[0][0][1][2] is True and got[1][0][0][7] == "doi:10/1"
    assert [len(r) for r, _ in oai.harvest(Scripted(), "http://x", most_pages=1)] == [2]
    assert oai.parse_page('<OAI-PMH><error code="noRecordsMatch"/></OAI-PMH>') == ([], "", "noRecordsMatch")
    with pytest.raises(ValueError):
        oai.parse_page("<html/>")
    assert oai.list_url("http://x", set_="a b", token="") == "http://x?verb=ListRecords&metadataPrefix=oai_dc&set=a%20b"
    many = oai.stretches({"set": "a, b", "from": "2020-01-01", "cuts": "2020-03-01,2020-02-01"})
    assert [(r["set_"], r["from_"], r["until"]) for r in many][:3] == [("a", "2020-01-01", "2020-01-31"), ("a", "2020-02-01", "2020-02-29"), ("a", "2020-03-01", "")] and len(many) == 6
    stream = oai._StreamReader({"base": "http://x"}, Scripted)
    at, seen = stream.initialOffset(), []
    for _ in range(5):
        rows, at = stream.read(at)
        seen += [r[0] for r in rows]
    assert seen == ["r1", "r2", "r3"] and at["token"] == ""


def test_heights(spark, tmp_path):
    cells = [row * 50 + col if (row, col) != (3, 4) else raster.VOID for row in range(601) for col in range(601)]
    (tmp_path / "N10E010.hgt").write_bytes(struct.pack(f">{len(cells)}h", *cells))
    read = heights.read_heights(spark, str(tmp_path))
    s = raster.stats(read).first()
    assert (s.voids, s.lowest, s.highest) == (1, 0, 600 * 51)
    assert read.where("row = 2 and col = 7").first().m == 107
    small = raster.reduce(read.where("row < 6 and col < 6"), 3).where("row = 1 and col = 1").first()
    assert small.m == sum(r * 50 + c for r in (3, 4, 5) for c in (3, 4, 5) if (r, c) != (3, 4)) // 8
    with pytest.raises(ValueError):
        heights.decode(b"12")


def test_raster_means_are_cut_towards_zero(spark):
    cells = spark.createDataFrame([(0, 0, -7), (0, 1, -8), (2, 2, raster.VOID)], "row int, col int, m int")
    assert {tuple(r) for r in raster.reduce(cells, 2).collect()} == {(0, 0, -7), (1, 1, raster.VOID)}
    tiles = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "tile_x int, tile_z int")
    acts = raster.residency(tiles, tiles.where("tile_x > 0"), 0, 0, 1).collect()
    assert {(r.tile_x, r.action) for r in acts} == {(0, "load"), (1, "keep"), (2, "evict")}


def test_images(spark, tmp_path):
    facts = spark.createDataFrame([(1, 5, 0, 1, 1), (2, 4, 0, 1, 1)], "fact_id long, subject long, from_day int, predicate long, source_ref long")
    sources = spark.createDataFrame([(1, "s")], "source_id long, source_name string")
    path = f"{tmp_path}/image"
    write_image(path, facts=facts, sources=sources)
    image = Image(spark, path)
    assert image.section("facts").count() == 2 and image.section("loci") is None and image.skipped == []
    with pytest.raises(ImageRefused, match="unsourced"):
        write_image(f"{tmp_path}/bad", facts=facts.withColumn("source_ref", F.lit(9).cast("long")), sources=sources)
    facts.withColumn("subject", F.lit(6).cast("long")).write.mode("overwrite").parquet(f"{path}/facts")
    with pytest.raises(ImageRefused, match="hash"):
        Image(spark, path)
    facts.limit(1).write.mode("overwrite").parquet(f"{path}/facts")
    with pytest.raises(ImageRefused, match="size"):
        Image(spark, path)
    with pytest.raises(ImageRefused, match="manifest") as refused:
        Image(spark, f"{tmp_path}/none")
    assert refused.value.status in STATUS


def test_parts_of_images(spark, tmp_path):
    base = f"file://{tmp_path}/whole"
    for n in (0, 1, 3):
        write_image(part_path(base, n), catalogue=spark.createDataFrame([(n * 10 + i, f"t{i}") for i in range(3)], "entry_id long, title string"))
    assert part_path(base, 12).endswith("whole.part012")
    with pytest.raises(ImageRefused, match="missing part"):
        parts(spark, base)
    found = [base, part_path(base, 1)]
    assert parts(spark, base, probe=0) == found
    assert union_section(spark, found, "catalogue").count() == 6 and union_section(spark, found, "facts") is None
    image = Image(spark, base)
    assert image.at("catalogue", 2, ["entry_id"]).first().entry_id == 1 and image.at("catalogue", 4, ["entry_id"]).count() == 0 == image.at("loci", 1, ["x"]).count()


def test_components_and_holdings(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (100, 80), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 80: 80, 90: 80, 100: 80}
    rows = spark.createDataFrame([(1, ["oclc:1"]), (2, ["oclc:1"]), (3, ["oclc:2"]), (4, []), (6, ["oclc:2", "oclc:9"])], "record_no long, keys array<string>")
    assert {tuple(r) for r in holdings_clusters(rows).collect()} == {(1, 1), (2, 1), (3, 3), (6, 3)}


def test_similar_names_are_all_found(spark):
    state, names = 12345, []
    for i in range(260):
        state = (state * 1664525 + 1013904223) % 2**32
        names.append((i, f"First{(state >> 8) % 6} Middle{(state >> 13) % 6} Last{(state >> 18) % 8}" + (" Minor" if (state >> 23) % 3 == 0 else "")))
    got = {(r.left, r.right) for r in similar_pairs(spark.createDataFrame(names, "id long, name string"), "id", "name").collect()}
    sets = {i: frozenset(n.lower().split()) for i, n in names}
    rep = {}
    for i, s in sets.items():
        rep.setdefault(s, i)
    want = {(a, b) for s, a in rep.items() for u, b in rep.items() if a < b and 65536 * len(s & u) // len(s | u) >= 36045} | {(rep[s], i) for i, s in sets.items() if rep[s] != i}
    assert got == want
    short = spark.createDataFrame([(1, "WHO"), (2, "World Health Organization"), (3, "OW"), (4, None), (5, "")], "id long, name string")
    assert [tuple(r) for r in abbreviations(short, "id", "name").collect()] == [(1, 2)]


def test_names_that_share_frequent_words_do_not_meet(spark):
    from annalist.operators import setjoin

    names = spark.range(400).selectExpr("id", "concat('essays studies n', id) as name")
    ranks = names.selectExpr("id", "array(id, 1000L, 1001L) as ranks")
    keys = setjoin._keys(ranks, setjoin.PROPOSE)
    # Two words of three are not enough, so none stands under the two that all have.
    assert keys.where(f"k = {(1000 << 32) + 1001}").where("n between least and most and twin").count() == 0
    assert setjoin.similar_pairs(names, "id", "name").count() == 0


def test_similar_names_at_all_thresholds(spark):
    import random
    from itertools import combinations

    from annalist.operators.setjoin import similar_pairs

    r = random.Random(5)
    sets = {i: frozenset(r.sample("abcdefghij", r.choice([1, 1, 2, 3, 4, 6, 9]))) for i in range(140)}
    least = {}
    for i, x in sets.items():
        least.setdefault(x, i)
    names = spark.createDataFrame([(i, " ".join(x)) for i, x in sets.items()], "id long, name string")
    for threshold in (4000, 20000, 36045, 52428, 65536):
        want = {(least[x], i, 65536) for i, x in sets.items() if least[x] != i}
        for x, y in combinations(least, 2):
            score = len(x & y) * 65536 // len(x | y)
            if x & y and score >= threshold:
                want.add((*sorted((least[x], least[y])), score))
        assert sorted(tuple(p) for p in similar_pairs(names, "id", "name", threshold).collect()) == sorted(want)


def test_baked_tiles_share_files(spark, tmp_path):
    from pathlib import Path

    cells = spark.range(120).selectExpr("cast(id as int) as row", "cast(id * 2 as int) as col", f"if(id % 10 < 4, {raster.VOID}, cast(id as int)) as m")
    path = str(tmp_path / "survey")
    plan = raster.bake(cells, path, 2, 4, "test")
    small = raster.reduce(cells, 2)
    assert {tuple(r) for r in plan.select("tile_z", "tile_x", "cells", "edges").collect()} == {tuple(r) for r in raster.tiles(small, 4).collect()}
    want = {tuple(r) for r in raster.field(small, 4, 0).select("tile_z", "tile_x", "row", "col", "m").collect()}
    assert {tuple(r) for r in spark.read.parquet(path).selectExpr("tile_z", "tile_x", "inline(samples)").collect()} == want
    assert len(list(Path(path).rglob("*.parquet"))) < plan.count()
