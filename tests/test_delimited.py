import csv
import io

import pytest
from pyspark.sql import functions as F

from annalist.sources import delimited as d


def line(**over):
    f = [""] * 26
    f[0], f[1], f[16], f[18], f[11] = "id", "allow", "1850", "eng", "Title"
    for k, v in over.items():
        f[int(k[1:])] = v
    return "\t".join(f)


HOLDINGS = [
    (line(), None), (line() + "\r", None), (line(f0="  id  ", f1=" deny "), None), (line(f16="c1850"), None), (line(f16="[1850-51]"), None), (line(f16="1850-1900"), None), (line(f16=""), None), (line(f18=""), None), (line(f11='a "b'), None),
    ("", "skip"), ("\r", "skip"), (None, "skip"), (line(f0="  "), "identifier"), (line(f1="ALLOW"), "access"), (line(f1=""), "access"), (line(f16="18500"), "year"), (line(f16="185"), "year"), (line(f16="MDCCC"), "year"),
    (line(f18="en"), "language"), (line(f18="ENG"), "language"), (line(f18="e1g"), "language"), (line() + "\t", "fields"), ("a\tb", "fields"), (line(f11="x" * 300000), None), ("x" * 300000, "fields"),
]


def test_holdings(spark):
    rows = [(i, t, "clash", "clash") for i, (t, _) in enumerate(HOLDINGS)]
    raw = spark.createDataFrame(rows, "record_no long, record_text string, text string, record string")
    records = d.holdings_records(raw)
    bad = {r.record: r.reasons for r in d.rejects(records, d.HOLDINGS).collect()}
    for i, (text, why) in enumerate(HOLDINGS):
        assert (i in bad) == (why not in (None, "skip")), (i, text and text[:80])
        assert i not in bad or any(why in r for r in bad[i]), bad[i]
    valid = {r.record: r for r in d.holdings_valid(records).collect()}
    assert set(valid) == {i for i, (_, w) in enumerate(HOLDINGS) if w is None}
    assert valid[3].year == 1850 and valid[2].identifier == "id"


HEADER = "id,title,featureTypes,reprLat,reprLong,minDate,maxDate,locationPrecision,extent,connectsWith"


def place(**over):
    row = dict(id="1", title="Rome", featureTypes="settlement", reprLat="41.9", reprLong="12.5", minDate="-753", maxDate="640", locationPrecision="precise", extent="", connectsWith="2,3") | over
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([row[c] for c in HEADER.split(",")])
    return out.getvalue()


GAZETTEER = [
    (place(), None), (place(title='a "b", c\nd'), None), (place(title=""), None), (place(title='""'), None), (place(minDate="", maxDate=""), None), (place(reprLat="-90", reprLong="180.0"), None), (place() + "\r", None), (place(minDate="5", maxDate="5"), None),
    ("", "skip"), (None, "skip"), (place(id="0"), "id"), (place(id="-1"), "id"), (place(id="P1"), "id"), (place(id=""), "id"), (place(reprLat="91"), "reprLat"), (place(reprLat="1e1"), "reprLat"), (place(reprLong="-180.1"), "reprLong"),
    (place(minDate="early"), "minDate"), (place(minDate="700"), "minDate > maxDate"), (place(maxDate="1.5"), "maxDate"), (place() + ",x", "fields"), (place().replace("Rome", 'Ro"me'), "quoting"), (place().replace("Rome", '"Rome" x'), "quoting"),
    (place().replace("Rome", '"Rome'), "quoting"), (place(title="x" * 200000 + '"' * 2000), None),
]


def test_gazetteer(spark):
    raw = spark.createDataFrame([(i, HEADER, t) for i, (t, _) in enumerate(GAZETTEER)], "record_no long, header_text string, record_text string")
    records = d.gazetteer_records(raw)
    bad = {r.record: r.reasons for r in d.rejects(records, d.GAZETTEER).collect()}
    for i, (text, why) in enumerate(GAZETTEER):
        assert (i in bad) == (why not in (None, "skip")), (i, text and text[:80], bad.get(i))
        assert i not in bad or any(why in r for r in bad[i]), bad[i]
    valid = {r.record: r for r in d.gazetteer_valid(records).collect()}
    assert valid[1].title == 'a "b", c\nd' and valid[0].connects == [2, 3] and valid[0].lat_raw == round(41.9 * 65536)


def test_other_header_and_missing_column(spark):
    raw = spark.createDataFrame([(1, "title,id,reprLat,reprLong,minDate,maxDate,featureTypes,locationPrecision,connectsWith", "A,7,1,2,,,x,rough,"), (2, "id,title", "1,A"), (3, None, "1,A")], "record_no long, header_text string, record_text string")
    records = d.gazetteer_records(raw)
    assert {r.record: r.reasons for r in d.rejects(records, d.GAZETTEER).collect()} == {2: ["the header lacks a column"], 3: ["the header lacks a column"]}
    assert d.gazetteer_valid(records).first().place == 7


def test_empty_tables(spark):
    none = spark.createDataFrame([], "record_no long, header_text string, record_text string")
    assert d.rejects(d.holdings_records(none), d.HOLDINGS).count() == 0 and d.gazetteer_valid(d.gazetteer_records(none)).count() == 0


@pytest.mark.parametrize("text", ["a,b", '"a,b",c', '""', '"",""', '"a""b"', '"""a"""', ",", "", '"a\nb",'])
def test_fields_agree_with_a_csv_reader(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(d.quoted_fields(F.col("t")).alias("f")).first().f
    assert got == (next(csv.reader(io.StringIO(text))) if text else [""])


@pytest.mark.parametrize("text", ['a"b', '"a"b', '"a', 'a,"b" ,c', '"a" "b"'])
def test_broken_quoting(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(d.quoted_fields(F.col("t")).alias("f")).first().f is None
