import pytest
from pyspark.sql import functions as F

from annalist.functions import dates, language, markup
from annalist.functions import texts as t
from annalist.functions.numbers import degrees_to_raw, read_year, signed_int


def each(spark, column, rows, schema="a string"):
    """The column for each row, in one job."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"n int, {schema}").coalesce(1)
    return [r.x for r in df.select("n", column.alias("x")).sort("n").collect()]


@pytest.fixture(autouse=True)
def columns(spark):
    """Columns need a session."""
    global A, B, DATE
    A, B = F.col("a"), F.col("b")
    DATE = (dates.day_of_date(F.col("y"), F.col("m"), F.col("d")), "y int, m int, d int")


def test_identity(spark):
    first, second, king, e, none, empty = each(spark, t.name_identifier(A), ["tgn,7132789", "tgn,7729192", "king", "é", None, ""])
    assert first == second and (king, e, none, empty) == (3658736598, 513665217, None, 2166136261)


def test_passages(spark):
    cases = [("5", (0, 0, 5)), ("3.12", (0, 3, 12)), ("3.12.4", (3, 12, 4)), ("1.2.3.4", None), ("1..3", None), ("1.", None), ("1-5", None), ("99999999999", None), ("", None), ("4294967296", None), (None, None)]
    got = each(spark, t.passage_locus(A), [c for c, _ in cases])
    assert [g and tuple(g) for g in got] == [w for _, w in cases]


REFERENCES = [
    ("https://www.Example.org/x/", "http://example.org/x", True), ("example.org/x?utm_source=a&id=7", "example.org/x?id=7", True), ("example.org/?id=7", "example.org/?id=8", False), ("https://doi.org/10.1000/A", "10.1000/a", True),
    ("http://dx.doi.org/10.1000/a", "10.1000/a", True), ("https://arxiv.org/abs/1234.5678v2", "arxiv.org/pdf/1234.5678.pdf", True), ("10.1/a", "10.1/b", False), ("example.org/x#frag", "example.org/x", True), ("a.org?UTM_source=1", "a.org", False),
]


def test_references(spark):
    left, right = (each(spark, t.normalise_reference(A), [r[i] for r in REFERENCES]) for i in (0, 1))
    assert [x == y for x, y in zip(left, right)] == [r[2] for r in REFERENCES], (left, right)


def test_abbreviations(spark):
    cases = [("WHO", "World Health Organization", True), ("WO", "World Health Organization", True), ("OW", "World Health Organization", False), ("W", "World Health", False), ("WHO", "Whole", False), ("", "x y", False)]
    assert each(spark, t.is_abbreviation(A, B), [c[:2] for c in cases], "a string, b string") == [c[2] for c in cases]


def test_similarity(spark):
    cases = [("John Smith", "smith, JOHN", 65536), ("a b", "c d", 0), ("", "a", 0), ("a b c", "a b d", 32768)]
    assert each(spark, t.jaccard_raw(t.token_set(A), t.token_set(B)), [c[:2] for c in cases], "a string, b string") == [c[2] for c in cases]


def test_numbers(spark):
    cases = [("37", 37 * 65536), ("-118", -118 * 65536), ("0.5", 32768), ("", None), ("unlocated", None), ("999", None), ("-0.000007629", 0), ("41.9", 2745958), (None, None)]
    assert each(spark, degrees_to_raw(A), [c for c, _ in cases]) == [w for _, w in cases]
    assert each(spark, read_year(A), ["c1850", "18500", "12 1850/51", "", "a1b1999"]) == [1850, 0, 1850, 0, 1999]
    assert each(spark, signed_int(A), [" -430 x", "+5", "x", "99999999999"]) == [-430, 5, None, None]


def test_days_there_and_back(spark):
    cases = [(1970, 1, 1), (-480, 1, 1), (0, 3, 1), (2000, 2, 29), (-4000, 1, 1), (9999, 12, 31), (-1, 12, 31), (1600, 2, 29), (1900, 3, 1)]
    days = each(spark, DATE[0], cases, DATE[1])
    assert days[:4] == [0, -894845, -719468, 11016]
    assert each(spark, dates.year_of_day(A), days, "a long") == [c[0] for c in cases]


def test_tei_windows(spark):
    cases = [("1863", (1863, 1, 1), (1863, 12, 31)), ("1864-02", (1864, 2, 1), (1864, 2, 29)), ("1863-05-01", (1863, 5, 1), (1863, 5, 1)), ("-0480-09", (-480, 9, 1), (-480, 9, 30)), ("1863-13", (1863, 1, 1), (1863, 12, 31)), ("1863-02-30", (1863, 2, 1), (1863, 2, 28))]
    got = each(spark, dates.tei_window(A), [c[0] for c in cases] + ["circa", None])
    first, last = (each(spark, DATE[0], [c[i] for c in cases], DATE[1]) for i in (1, 2))
    assert [tuple(g) for g in got[:-2]] == list(zip(first, last)) and got[-2:] == [None, None]


def test_languages(spark):
    words = language.language_words(spark)
    assert words.where("canonical").count() == 64 and words.groupBy("word").count().where("count > 1").isEmpty()
    assert each(spark, language.language_of(A), ["el", "grc", "xx"]) == [41, 3, 0]


def test_markup():
    body = "<!-- <a>no</a> --><x:title n='1 > 0' xml:lang=\"la\">A &amp; &#233;<b>c</b> <![CDATA[<raw>]]> &nope; <title>in</title></x:title><br/>"
    assert markup.first_text(body, "title") == "A & éc <raw> &nope; in"
    assert [e.name for e in markup.elements(body)] == ["title", "b", "b", "title", "title", "title", "br"]
    assert markup.attribute("<x a='1 > 0' xml:lang=\"la\">", "lang") == "la" and markup.attribute("<x a='1'>", "b") is None
    assert markup.decode("&#1114112;&#x41;&lt;") == "&#1114112;A<"


def test_place_kinds(spark):
    assert each(spark, t.place_kinds(A), ["urban, river", "settlement,nothing", "", None]) == [7, 1, 0, 0]


def test_url_escape(spark):
    assert each(spark, t.url_escape(A), ["a b*~é/-._"]) == ["a%20b%2A~%C3%A9%2F-._"]
