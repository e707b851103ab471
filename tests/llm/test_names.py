import random

import numpy as np
import pytest
from pyspark.sql import functions as F  # noqa: F401

from annalist.llm.metric import assigned, capped, met, pairs_within_one, variants
from annalist.llm.names import NICKNAMES, parse, parsed_names, plain, variant_pairs
from annalist.storage import Workspace


def damerau(a, b):
    """The unrestricted distance, by the textbook."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    last = {}
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, at = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def words(seed, n, letters="abc", most=7):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_distances():
    a, b = words(1, 2000), words(2, 2000)
    b[:4], a[:4] = ["", "é", "ca", "abc"], ["", "e", "abc", "ca"]
    assert capped(a, b).tolist() == [min(3, damerau(x, y)) for x, y in zip(a, b)]


@pytest.mark.parametrize("repeated", [0, 3, 1000])
def test_radius_join_is_exact_for_any_pivots(spark, repeated):
    base = "".join(random.Random(9).choice("abcdefgh") for _ in range(40))
    long = [base, base[1:], base[:7] + base[8:20] + base[21:], base[:3] + base[4] + base[3] + base[5:], base[:5] + base[6] + base[5] + base[7:30] + base[31] + base[30] + base[32:], base[:24], base[:25], base[:26], base[:23] + "x"]
    keys = sorted(set(words(3, 110, "ab", 6) + words(4, 60, "abcdefgh", 9) + long + ["x" * 300, "x" * 299 + "y", "", "a"]))
    rows = spark.createDataFrame([(k, 2 if i < repeated else 1) for i, k in enumerate(keys)] + [(None, 1)], "key string, freq long")
    space = Workspace(spark, "exact")
    true = {(x, y): damerau(x, y) for x in keys for y in keys if x < y and abs(len(x) - len(y)) < 3 and (len(x) < 100 or len(y) >= 100)}
    cells = assigned(space.write(rows.where("key is not null"), "rows"), space)
    assert {(r.a, r.b) for r in pairs_within_one(cells).collect()} == {p for p, d in true.items() if d == 1}
    known = rows.where("key is not null").select("key")
    assert {(r.a, r.b): r.distance for r in met(known, known).where("a < b").collect()} == {p: d for p, d in true.items() if d <= 2}
    got = {(r.key, r.near): r.distance for r in variants(rows, space).collect()}
    assert all(true[min(p), max(p)] == d for p, d in got.items()) and {p for p, d in true.items() if d == 1} <= set(got)


@pytest.mark.parametrize(
    "name, body, key, first, second",
    [
        ("Swift, Jonathan", False, "swift", "jonathan", None), ("Bob Miller", False, "miller", "robert", None), ("MILLER, R. J.", False, "miller", "r", "j"), ("Hounsooden, Thomas de", False, "hounsooden", "thomas", None),
        ("de Hounsooden, Prof. Thomas [author]", False, "hounsooden", "thomas", None), ("Quaenkahart Philippa, 1853-1940", False, "quaenkahart", "philippa", None), ("Wm. Kraxauholm (b. 1700)", False, "kraxauholm", "william", None),
        ("Pu1lyfeld, Will1am", False, "pu1lyfeld", "william", None), ("The Branenkaburg Learned Company of Public Records", True, "branenkaburg", "lea-com-pub-rec", None), ("Inst. Inscr. Caltoxchaum", True, "caltoxchaum", "ins-ins", None),
        ("Manuscripts of Xy, Museum of", True, "xy", "mus-man", None), ("王维", False, "王维", None, None), ("...", False, "...", None, None), ("", False, None, None, None), ("x" * 20000, False, "x" * 20000, None, None),
    ],
)
def test_names_taken_apart(name, body, key, first, second):
    given = {w: full for full, forms in NICKNAMES.items() for w in (full, *forms.split())} | {"wm": "william", "jonathan": "jonathan", "will1am": "william"}
    assert parse(plain(name), given)[:4] == (body, key, first, second)


def test_variants_meet_and_namesakes_do_not(spark):
    authors = [
        (1, "Brennert, Thomas", 1600, 1660), (2, "Tom Brennert", 1601, 1660), (3, "T. BRENNERT", None, None), (4, "Brennert, Thomas", 1750, 1810), (5, "Brenenrt, Thos.", 1750, 1811), (6, None, 1750, 1811),
        (7, "Royal Society of Mines of Oxbeach", 1700, 1800), (8, "Roy. Soc. Mines Oxbeach", None, None), (9, "Brennert, Ursula", 1600, 1660),
    ]
    works = [(101, "Brennert, Tom", 1640), (102, "Brennert, T.", 1780), (103, "Mines of Oxbeach, Royal Society of", 1750), (104, None, 1640), (105, "Brennert, Thomas", 1700), (101, "Brennert, Tom", 1640), (106, "Ulla Brennert", None)]
    a = spark.createDataFrame(authors, "id long, name string, from_year int, to_year int")
    w = spark.createDataFrame(works, "id long, name string, year int").selectExpr("*", "1 as key", "'x' as head")
    got = {(r.id_a, r.id_b) for r in variant_pairs(a, w).collect()}
    assert {(1, 2), (4, 5), (7, 8), (1, 101), (2, 101), (4, 102), (5, 102), (7, 103), (8, 103), (9, 106)} <= got
    assert not {(1, 4), (1, 5), (2, 4), (1, 102), (4, 101), (1, 105), (4, 105), (1, 9), (9, 101)} & got


def test_no_names(spark):
    a = spark.createDataFrame([(1, None, None, None)], "id long, name string, from_year int, to_year int")
    assert variant_pairs(a, spark.createDataFrame([], "id long, name string, year int")).count() == 0


def test_names_one_slip_apart_as_typed(spark):
    """A swap in or beside two strokes that are rewritten to one letter is still one slip."""
    authors = [(1, "Kürnziegate, Yolande", 1752, 1820), (2, "Krünziegate, Yolande", 1752, 1820), (3, "Drnedooby, Katherine", None, None), (4, "Drendooby, Katherine", None, None), (5, "K" + "xz" * 20 + "rne, Anna", None, None), (6, "K" + "xz" * 20 + "nre, Anna", None, None)]
    a = spark.createDataFrame(authors, "id long, name string, from_year int, to_year int")
    got = {(r.id_a, r.id_b) for r in variant_pairs(a, spark.createDataFrame([], "id long, name string, year int")).collect()}
    assert got == {(1, 2), (3, 4), (5, 6)}


PEOPLE = ["Brennert", "Osgood", "Lindqvist", "Yarrow", "Zander", "Quillfeather", "Tollemark", "Wexcombe"]
GIVEN = ["Thaddeus", "Philomena", "Bartholomew", "Wilhelmina"]


def test_given_names_are_learned(spark):
    """No list knows these names: they, their short forms, slips and pet names are told by the others."""
    names = [f"{s}, {g}" for s in PEOPLE for g in GIVEN]
    names += ["Osgood, Barth.", "Yarrow, Thaddues", "Philomena Zander", "Zander Philomena", "Wexcombe Philomna", "Mina Brennert", "Brennert, T.", "Bartw. Tollemark"]
    rows = spark.createDataFrame([(n, 1) for n in names], "name string, n long")
    parsed, _ = parsed_names(rows, Workspace(spark, "learned"), {}, ())
    got = {r.name: (r.key, r.first) for r in parsed.collect()}
    assert {n: got[n] for n in names[-8:]} == {
        "Osgood, Barth.": ("osgood", "bartholomew"), "Yarrow, Thaddues": ("yarrow", "thaddeus"), "Philomena Zander": ("zander", "philomena"), "Zander Philomena": ("zander", "philomena"),
        "Wexcombe Philomna": ("wexcombe", "philomena"), "Mina Brennert": ("brennert", "mina"), "Brennert, T.": ("brennert", "t"), "Bartw. Tollemark": ("tollemark", "bartholomew"),
    }
    # Whoever has the surname and both dates of another is that other, so Mina is Wilhelmina, and elsewhere too.
    authors = [(i, n, 1600 + i, 1660 + i) for i, n in enumerate(names[:32])]
    authors += [(100, "Mina Brennert", 1603, 1663), (101, "Mina Osgood", 1607, 1667), (102, "Mina Yarrow", None, None)]
    a = spark.createDataFrame(authors, "id long, name string, from_year int, to_year int")
    pairs = {(r.id_a, r.id_b) for r in variant_pairs(a, spark.createDataFrame([], "id long, name string, year int"), {}, ()).collect()}
    assert pairs == {(3, 100), (7, 101), (15, 102)}


def test_two_slips_in_a_name_that_others_spell_right(spark):
    authors = [(i, "Schespylin, Ursula", None, None) for i in range(4)] + [(10, "Schespyhn, Ursula", None, None), (11, "Ursula Schespyiln", None, None), (12, "Schesbyhn, Ursula", None, None)]
    a = spark.createDataFrame(authors + [(20, "Ursula  Schespylin", None, None)], "id long, name string, from_year int, to_year int")
    got = {(r.id_a, r.id_b) for r in variant_pairs(a, spark.createDataFrame([], "id long, name string, year int")).collect()}
    assert {(0, 10), (10, 11), (10, 12), (10, 20), (3, 11)} <= got and (0, 12) not in got


@pytest.mark.parametrize(
    "name, body, key, first, second",
    [
        ("Musheim, Nathaniel de", False, "musheim", "nathaniel", None), ("Nathaniel de Musheim", False, "musheim", "nathaniel", None), ("Bdroomann, Katherine van der [author]", False, "bdroomann", "katherine", None),
        ("Socpiov, Samuel Robert de", False, "socpiov", "samuel", "robert"), ("Velsok, Smithian Museum, The", True, "museum", "vel-smi", None), ("Museum of Mines (the)", True, "mines", "mus", None), ("Inst. of the Arts, de", True, "arts", "ins", None), ("of the and", True, "and", "of-the", None),
    ],
)
def test_surnames_like_words_of_organisations(name, body, key, first, second):
    given = {w: w for w in ("nathaniel", "katherine", "samuel", "robert")}
    assert parse(plain(name), given)[:4] == (body, key, first, second)


def test_a_surname_like_an_organisation_meets_its_variants(spark):
    a = spark.createDataFrame([(i, n, 1600, 1660) for i, n in enumerate(["Musheim, Nathaniel de", "Nathaniel de Musheim", "Brennert, Nathaniel", "Museum of Mines, the", "Museum of Mines"])], "id long, name string, from_year int, to_year int")
    w = spark.createDataFrame([(101, "de Musheim, N.", 1640)], "id long, name string, year int")
    assert {(0, 1), (0, 101), (1, 101), (3, 4)} <= {(r.id_a, r.id_b) for r in variant_pairs(a, w).collect()}
