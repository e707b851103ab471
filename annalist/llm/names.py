"""Names of persons and organisations as people type them: taken apart, and the variants of one entity linked.

What the words of names are is learned from all names: those that stand behind a comma more often than before it
are given names. All words go through the radius join in the metric space of strings. By it a given name is led to
the more frequent spelling beside it, as short forms are to the one name they begin or contract; given names that
share surname and dates of life are forms of one. The part of a name that tells most (a surname, the place of an
organisation) is its key. Names whose keys are variants of each other, or both of a more frequent key, are compared
by their other parts and by the time they lived. No rule asks how often a word occurs but in relation to others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.metric import variants
from annalist.storage import Workspace, pick

#: Given names with their usual short and foreign forms, an optional input of lexicon().
NICKNAMES = {
    "alexander": "sandy alec alex sasha", "andrew": "andy", "anna": "annie nan", "anthony": "tony", "augustus": "gus", "barbara": "babs",
    "benjamin": "ben benny", "catherine": "cathy", "charles": "charlie chuck", "constance": "connie", "daniel": "dan danny", "david": "dave davy",
    "dorothea": "thea dora dolly", "edward": "ned ted eddie", "elizabeth": "betty eliza bess lizzie beth", "etienne": "tiennot", "francis": "frank",
    "francoise": "fanchon", "frederick": "fred freddy", "friedrich": "fritz", "george": "georgie", "gerald": "gerry", "henry": "harry hal",
    "isabella": "bella", "james": "jim jimmy jamie", "jeremias": "jem", "johannes": "hans jan", "john": "jack johnny", "joseph": "joe", "katherine": "kate kitty kathy",
    "lawrence": "larry", "leopold": "poldi", "ludwig": "lutz", "margaret": "meg peggy maggie", "martha": "patty", "mary": "molly polly",
    "matthias": "matz", "michael": "mike mick", "nathaniel": "nat", "nicholas": "nick", "oswald": "oz", "patrick": "pat paddy", "peter": "pete",
    "philip": "pip", "philippa": "pippa", "quentin": "quin", "richard": "dick", "robert": "bob rob", "rosalind": "roz", "samuel": "sam", "sarah": "sally",
    "stephen": "steve", "theodore": "theo", "thomas": "tom", "ursula": "ulla", "valentin": "velten", "victoria": "vicky", "walter": "walt",
    "william": "bill will", "yolande": "yoli", "zacharias": "zach",
}
#: Words before a surname, titles, and words that tell an organisation (by their beginnings), the
#: last an optional input of parsed_names().
PARTICLES = set("de du des della del di da von van der den af le la zu zur ten ter".split())
TITLES = set("prof professor canon hon honourable dr doctor rev reverend sir lady mr mrs miss fr herr frau author editor ed".split())
BODIES = ("inst", "univ", "acad", "soc", "assoc", "comm", "compan", "museum", "mus", "archiv", "arch", "board", "bd", "library", "college", "ministry", "department", "council")
CONTRACTED = {"bd": "board", "co": "company", "dept": "department"}
FILLERS = set("of for the and de".split())
#: A word has a letter; digits typed or read for letters stay in it.
WORD = r"[a-z0-9]*[a-z][a-z0-9]*"
YEARS = re.compile(r"\(?\b(?:b|born)\.?\s*(\d{4})\b\)?|(\d{4})\s*[-–—]\s*(\d{4})?")

READ = "name string, text string, words array<string>, hints array<struct<word: string, role: string>>"
PARSED = "name string, body boolean, key string, first string, second string, born int, died int"


def plain(text: str) -> str:
    """Without accents and case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae")


def _bare(text: str) -> str:
    """Without years, numbers and remarks in square brackets."""
    return re.sub(r"\[[^\]]*\]|\b\d+\b", " ", YEARS.sub(" ", text))


def _of(text: str) -> bool:
    return bool(re.search(r"\b(?:of|for)\b|&", text))


def read(name: str) -> tuple[str, list[str], list[dict]]:
    """The plain text of a name, its distinct words, and what its shape says of them.

    Roles: s a surname, g a given name, o part of an organisation's name, d cut short with a stop.
    """
    text = plain(name)
    bare = _bare(text)
    words = list(dict.fromkeys(re.findall(WORD, bare)))
    if not words:
        return text, [" ".join(bare.split())] if bare.strip() else [], []
    hints = [(w, "d") for w in set(re.findall(rf"({WORD})\.", bare)) if len(w) > 1]
    if _of(bare):
        return text, words, [{"word": w, "role": r} for w, r in hints + [(w, "o") for w in words if w not in FILLERS]]
    parts = [[w for w in re.findall(WORD, p) if w not in TITLES] for p in re.sub(r"\([^)]*\)", " ", bare).split(",")]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        own = [w for w in parts[0] if w not in PARTICLES]
        hints += [(w, "s") for w in own[-1:]] + [(w, "g") for p in parts[1:] for w in p if len(w) > 1 and w not in PARTICLES]
    elif parts:
        led = [i for i, w in enumerate(parts[0]) if w in PARTICLES]
        if led and 0 < led[0] and led[-1] + 1 < len(parts[0]):
            hints += [(parts[0][led[-1] + 1], "s")] + [(w, "g") for w in parts[0][: led[0]] if len(w) > 1]
    return text, words, [{"word": w, "role": r} for w, r in hints]


def _read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(n, *read(n)) for n in batch["name"]], columns=["name", "text", "words", "hints"])


def _organisation(text: str, bodies: tuple[str, ...]) -> tuple[str, str]:
    """The place of an organisation, and the beginnings of its other words in order."""
    text = text.replace("&", " and ")
    left, comma, right = text.partition(",")
    if comma and re.search(r"\b(?:of|for)\W*$", right):
        text, comma = f"{right.strip()} {left}", ""
    inside = re.search(r"\(([^)]*)\)", text)
    telling = lambda part: [t for t in re.findall(WORD, part) if t not in FILLERS]
    tokens = telling(text) or re.findall(WORD, text)
    known = lambda t: t.startswith(bodies)
    if inside and (place := telling(inside[1])):
        place = place[-1]
    elif comma and right.strip(" ."):
        place = (telling(right) or tokens)[-1]
    elif (lead := re.match(rf"\W*({WORD})\.\s+[a-z]{{4,}}", text)) and not known(lead[1]) and re.search(r"\b(?:of|for)\b", text) and len(lead[1]) > 6:
        place = lead[1]
    elif re.match(r"\W*the\b", text) and len(tokens) > 2 and not known(tokens[0]) and re.search(r"\b(?:of|for)\b", text):
        place = tokens[0]
    else:
        place = tokens[-1]
    rest = list(tokens)
    rest.remove(place)
    return place, "-".join(CONTRACTED.get(t, t)[:3] for t in rest)


def parse(text: str, given: Mapping[str, str], bodies: tuple[str, ...] = BODIES) -> tuple[bool, str | None, str | None, str | None, int | None, int | None]:
    """Organisation or not, key, first and second given name (in full or one letter), years of birth and death.

    text: a plain() name; given: the words in it that are given names, with their full forms.
    """
    born = died = None
    for m in YEARS.finditer(text):
        born, died = int(m[1] or m[2]), int(m[3]) if m[3] else None
    text = _bare(text)
    words = re.findall(WORD, text)
    if not words:
        # No Latin letter: the text itself is the key.
        return False, " ".join(text.split()) or None, None, None, born, died
    is_given = lambda w: len(w) == 1 or w in given
    short = [w for w in re.findall(r"([a-z]{2,})\.", text) if w in CONTRACTED or (w not in TITLES and w not in given)]
    told = any(bodies and w.startswith(bodies) and (len(w) > 3 or f"{w}." in text or f"{w} " in text) for w in words)
    # A surname may begin like such a word: beside nothing but given names it is one.
    told = told and sum(not is_given(w) and w not in PARTICLES and w not in TITLES and w not in FILLERS for w in words) > 1
    if len(words) > 2 and (len(short) > 1 or _of(text) or told and (FILLERS & set(words) or len(words) > 3)):
        place, rest = _organisation(text, bodies or ("\0",))
        return True, place, rest, None, born, died
    text = re.sub(r"\([^)]*\)", " ", text)
    parts = [[w for w in re.findall(WORD, p) if w not in TITLES] for p in text.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return False, words[-1], None, None, born, died
    flat = [w for p in parts for w in p]
    rest: list[str]
    if len(parts) > 1:
        own = [w for w in parts[0] if w not in PARTICLES] or parts[0]
        key, rest = own[-1], own[:-1] + [w for p in parts[1:] for w in p if w not in PARTICLES]
        if len(own) == 1 and len(key) > 1 and key in given and rest and not any(is_given(w) for w in rest):
            key, rest = rest[-1], [key, *rest[:-1]]
    else:
        led = [i for i, w in enumerate(flat) if w in PARTICLES and any(v not in PARTICLES for v in flat[i + 1 :])]
        if led and led[-1] + 1 < len(flat):
            at = led[-1] + 1
        else:
            flat = [w for w in flat if w not in PARTICLES] or flat
            strange = [i for i, w in enumerate(flat) if not is_given(w)]
            at = max(strange, key=lambda i: (len(flat[i]), i)) if strange else len(flat) - 1
            if not strange and len(flat[at]) == 1:
                at = max(range(len(flat)), key=lambda i: len(flat[i]))
        key, rest = flat[at], [w for i, w in enumerate(flat) if i != at and w not in PARTICLES]
    known = [given.get(w, w) for w in rest]
    return False, key, known[0] if known else None, known[1] if len(known) > 1 else None, born, died


#: The least lengths of words that are taken for each other at a distance of one and of two.
LENGTHS = (4, 7)


#: How many times as often the other must occur, at a distance of two.
RARER = 2


def _beside(word: str, near: str) -> str:
    """SQL of whether two words are near enough to be spellings of one."""
    return f"(distance = 1 and least(length({word}), length({near})) >= {LENGTHS[0]} or distance = 2 and greatest(length({word}), length({near})) >= {LENGTHS[1]})"


def spellings(words: DataFrame, beside: DataFrame) -> DataFrame:
    """key, head, freq: each word with the words it may be a spelling of, itself and the more frequent ones beside it.

    words: key, freq; beside: variants() of them.
    """
    up = beside.join(words, "key").join(words.toDF("near", "above"), "near").where("above > freq or above = freq and near < key")
    up = up.where(_beside("key", "near")).where(f"distance = 1 or above >= {RARER} * freq")
    return words.select("key", F.col("key").alias("head"), "freq").unionByName(up.select("key", F.col("near").alias("head"), F.col("above").alias("freq")))


def lexicon(taken: DataFrame, beside: DataFrame, space: Workspace, nicknames: Mapping[str, str] = NICKNAMES) -> DataFrame:
    """word, canonical: the given names among the words of names, with the name in full that each stands for.

    taken: what read() gives; beside: variants() of the words; nicknames: full names with their short forms, or none.
    """
    spark = taken.sparkSession
    count = lambda role: F.count_if(F.col("role") == role).alias(role)
    often = taken.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    roles = taken.select(F.explode("hints").alias("h")).select("h.*").groupBy("word").agg(*map(count, "gsod"))
    words = space.write(often.join(roles, "word", "left").na.fill(0), "words")
    listed = [(w, full) for full, forms in nicknames.items() for w in (full, *forms.split())]
    told = words.join(spark.createDataFrame(listed, "word string, told string"), "word")
    told = space.write(told.select("word", "n", "d", "told"), "listed")
    certain = words.where("g > s").select("word", "n", "d").unionByName(told.drop("told")).distinct()
    # A word of which the shape of names says nothing is a slip in a given name if a more frequent one is beside it.
    unsaid = words.where("g = 0 and s = 0 and o = 0").select("word", "n", "d")
    by_slip = unsaid.join(beside.withColumnRenamed("key", "word"), "word").join(certain.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    slips = by_slip.where("m > n").where(_beside("word", "near")).select("word", "n", "d").distinct()
    given = space.write(certain.unionByName(slips).distinct(), "given")

    full = given.where("2 * d < n and word rlike '^[a-z0-9]+$'").select(F.col("word").alias("f"), F.col("n").alias("m"))
    slip = given.join(beside.withColumnRenamed("key", "word"), "word").join(full.withColumnRenamed("f", "near"), "near")
    slip = slip.where("m > n").where(_beside("word", "near")).groupBy("word").agg(F.max(F.struct("m", F.col("near"))).alias("f")).select("word", F.col("f.near").alias("f"))
    slip = space.write(slip, "slips")
    cut = given.unionByName(unsaid.where("2 * d >= n")).distinct().where("length(word) > 1 and word rlike '^[a-z0-9]+$' and (length(word) <= 4 or 2 * d >= n)")
    begun = full.withColumn("word", F.explode(F.expr("transform(sequence(2, greatest(length(f) - 1, 2)), i -> substring(f, 1, i))")))
    begun = begun.join(cut.hint("merge"), "word").where("m > n and f <> word").select("word", "f")
    ends = [F.substring(c, 1, 1) for c in ("word", "f")], [F.substring(c, -1, 1) for c in ("word", "f")]
    drawn = cut.where("length(word) <= 5 and 2 * d >= n").withColumn("a", ends[0][0]).withColumn("z", ends[1][0])
    drawn = drawn.join(full.withColumn("a", ends[0][1]).withColumn("z", ends[1][1]), ["a", "z"])
    drawn = drawn.where("m > n and length(f) > length(word) and f rlike concat('^', array_join(split(word, ''), '.*'), '$')").select("word", "f")

    step = lambda rows: rows.join(told.select(F.col("word").alias("f"), F.col("told").alias("t")), "f", "left").join(slip.select(F.col("word").alias("f"), F.col("f").alias("u")), "f", "left").select("word", F.coalesce("t", "u", "f").alias("f"))
    # A short form of several names stays what it is.
    one = step(begun.unionByName(drawn)).groupBy("word").agg(F.count_distinct("f").alias("k"), F.min("f").alias("one"))
    kinds = {"known": "boolean", "told": "string", "k": "long", "one": "string", "slip": "string"}
    part = lambda rows, **of: rows.select("word", *[F.expr(of.get(c, "null")).cast(kind).alias(c) for c, kind in kinds.items()])
    parts = part(given, known="true").unionByName(part(one, known="true", k="k", one="one")).unionByName(part(told, told="told")).unionByName(part(step(slip), slip="f"))
    known = parts.groupBy("word").agg(*[F.max(c).alias(c) for c in kinds]).where("known")
    canonical = F.coalesce("told", F.when(F.col("k") == 1, F.col("one")), F.when(F.col("k").isNull(), F.col("slip")), "word")
    return space.write(known.select("word", canonical.alias("canonical")), "lexicon")


def parsed_names(names: DataFrame, space: Workspace, nicknames: Mapping[str, str] = NICKNAMES, bodies: tuple[str, ...] = BODIES) -> tuple[DataFrame, DataFrame]:
    """name, body, key, first, second, born, died for each distinct name, and key, head: the keys it may stand for.

    names: name, n (how often). A key stands for itself and for each more frequent key that it is a variant of.
    """
    parallel = names.sparkSession.sparkContext.defaultParallelism
    parts = names.repartition(parallel * 2, "name").select("name")
    taken = space.write(parts.mapInPandas(_read_all, READ), "taken")
    spelled = taken.select(F.explode("words").alias("key")).groupBy("key").agg(F.count("*").alias("freq"))
    beside = variants(spelled, space)
    given = lexicon(taken, beside, space, nicknames)
    held = taken.select("name", F.explode("words").alias("word")).join(given, "word").groupBy("name").agg(F.collect_list("word").alias("w"), F.collect_list("canonical").alias("c"))

    def parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, *parse(t, {} if w is None else dict(zip(w, c)), bodies)) for n, t, w, c in zip(batch["name"], batch["text"], batch["w"], batch["c"])]
            yield pd.DataFrame(rows, columns=["name", "body", "key", "first", "second", "born", "died"]).astype({"born": "Int32", "died": "Int32"})

    parsed = taken.select("name", "text").join(held, "name", "left").mapInPandas(parse_all, PARSED)
    parsed = space.write(parsed.where("key is not null"), "parsed")
    freq = space.write(parsed.join(names, "name").groupBy("key").agg(F.sum("n").alias("freq")), "frequent")
    return parsed, space.write(spellings(freq, beside), "heads-of-keys")


def chief(heads: DataFrame) -> DataFrame:
    """key, head: of all keys that one may stand for the most frequent, of several the first."""
    return heads.groupBy("key").agg(F.min(F.struct((-F.col("freq")).alias("freq"), "head")).alias("h")).select("key", F.col("h.head").alias("head"))


def part_score(a: Column, b: Column) -> Column:
    """3 for equal names, 2 for one letter off, 1 for an initial, null where they contradict; 0 where one is absent."""
    starts = F.when(F.length(a) < F.length(b), b.startswith(a)).otherwise(a.startswith(b))
    return (
        F.when(a.isNull() | b.isNull(), 0)
        .when(a == b, F.when(F.length(a) > 1, 3).otherwise(1))
        .when(starts & (F.least(F.length(a), F.length(b)) < 6), 1)
        .when((F.least(F.length(a), F.length(b)) > 3) & (F.levenshtein(a, b, 2) >= 0) & (F.levenshtein(a, b, 2) <= 2), 2)
    )


def name_score(a: str, b: str) -> Column:
    """How far two names that share a key agree in their other parts; null where they contradict each other."""
    first = part_score(F.col(f"{a}.first"), F.col(f"{b}.first"))
    second = part_score(F.col(f"{a}.second"), F.col(f"{b}.second"))
    return F.when(F.col(f"{a}.body") == F.col(f"{b}.body"), first * 4 + second)


def _apart(a: Column, b: Column, years: int = 3) -> Column:
    return F.coalesce(F.abs(a - b) > years, F.lit(False))


#: Registers that name one person differ by so many years at most.
SLACK = 3
WORKS_SLACK = 2


def _lives(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names, "name").select("id", "body", "key", "first", "second", F.coalesce("from_year", "born").alias("born"), F.coalesce("to_year", "died").alias("died"))


def short_forms(persons: DataFrame, heads: DataFrame) -> DataFrame:
    """word, full: given names that stand for another, told by persons of one surname and the same dates of life.

    The more frequent name of a pair is the full one. The two must meet more than once, and the full one be what the
    other meets at least every second time it meets any, and every fourth time that it stands in a dated name at all.
    """
    dated = persons.where("not body and length(first) > 1 and born is not null and died is not null").join(chief(heads), "key").select("head", "born", "died", "first").distinct()
    often = dated.groupBy("first").agg(F.count("*").alias("n"))
    each = dated.join(often, "first")
    pairs = each.toDF("word", "head", "born", "died", "n").join(each.toDF("full", "head", "born", "died", "m"), ["head", "born", "died"]).where("word <> full")
    by = pairs.groupBy("word", "full", "n", "m").agg(F.count("*").alias("c"))
    every = F.sum("c").over(Window.partitionBy("word"))
    kept = by.withColumn("every", every).where("c > 1 and 2 * c >= every and 4 * c >= n and (m > n or m = n and full < word)")
    return kept.groupBy("word").agg(F.max(F.struct("c", "m", "full")).alias("k")).select("word", F.col("k.full").alias("full"))


def _in_full(rows: DataFrame, full: DataFrame) -> DataFrame:
    for c in ("first", "second"):
        rows = rows.join(full.toDF(c, "full"), c, "left").withColumn(c, F.coalesce("full", c)).drop("full")
    return rows


ENTITY = ("id", "body", "key", "first", "second", "born", "died")


def _candidates(a: DataFrame, b: DataFrame, heads: DataFrame) -> DataFrame:
    """a, b, score: pairs of rows that share a head of the key and the first letter of the given name, or one lacks it,
    and whose other parts do not contradict each other.

    A head that very many bear is split by the adaptive skew join, as only equality joins are used.
    """
    sides = []
    for side, rows in (("a", a), ("b", b)):
        held = F.struct(*[F.col(c) for c in rows.columns])
        sides.append(rows.join(heads.select("key", "head"), "key").select("head", F.substring("first", 1, 1).alias("letter"), held.alias(side)))
    a, b = sides
    lacks = lambda rows: rows.where("letter is null").drop("letter")
    full = a.join(b, ["head", "letter"]).select("a", "b")
    lone = lacks(a).join(b.drop("letter"), "head").select("a", "b").unionAll(a.where("letter is not null").drop("letter").join(lacks(b), "head").select("a", "b"))
    return full.unionAll(lone).withColumn("score", name_score("a", "b")).where("score is not null")


def variant_pairs(authors: DataFrame, works: DataFrame, nicknames: Mapping[str, str] = NICKNAMES, bodies: tuple[str, ...] = BODIES) -> DataFrame:
    """id_a, id_b, score: pairs of two authors, or of an author and a work, whose names mean the same entity.

    authors: id, name, from_year, to_year (null = unknown); works: id, name, year (null = unknown); ids of the two
    do not overlap. Rows without a name, or with one that holds no letter or digit, are in no pair. Repeated rows
    give the pairs of each; no rows, no pairs. Exact copies of a name are taken apart once for all of their rows.
    nicknames and bodies are lists that help where names themselves do not tell; both may be empty.
    """
    space = Workspace(authors.sparkSession, "names")
    authors = pick(authors, id="id", name="name", from_year="from_year", to_year="to_year").where("name is not null")
    works = pick(works, id="id", name="name", year="year").where("name is not null")
    counted = authors.select("name").unionAll(works.select("name")).groupBy("name").agg(F.count("*").alias("n"))
    names, heads = parsed_names(space.write(counted, "names"), space, nicknames, bodies)
    persons = space.write(_lives(authors, names), "told")
    full = space.write(short_forms(persons, heads), "short-forms")
    persons = space.write(_in_full(persons, full), "persons")

    # 1. Authors with authors; who is dated lends the dates to who is not.
    twos = space.write(_candidates(persons, persons, heads).where("a.id <> b.id").distinct(), "twos")
    known = "(b.born is not null or b.died is not null)"
    undated = "(a.born is null and a.died is null)"
    best = twos.where(f"{undated} and {known}").withColumn("top", F.max("score").over(Window.partitionBy("a.id"))).where("score >= top - 1")
    lent = best.groupBy(F.col("a.id").alias("id")).agg(
        F.min("b.born").alias("b0"), F.max("b.born").alias("b1"), F.min("b.died").alias("d0"), F.max("b.died").alias("d1")
    )
    clear = (F.coalesce(F.col("b1") - F.col("b0"), F.lit(0)) <= 2 * SLACK) & (F.coalesce(F.col("d1") - F.col("d0"), F.lit(0)) <= 2 * SLACK)
    lent = lent.where(clear).select("id", F.col("b0").alias("lent_born"), F.col("d1").alias("lent_died"))
    lived = persons.join(lent, "id", "left").withColumn("born", F.coalesce("born", "lent_born")).withColumn("died", F.coalesce("died", "lent_died")).drop("lent_born", "lent_died")
    lived = space.write(lived.select(*ENTITY), "lived")
    dates = lived.select("id", "born", "died").distinct()
    agree = ~_apart(F.col("ab"), F.col("bb"), SLACK) & ~_apart(F.col("ad"), F.col("bd"), SLACK)
    in_time = F.coalesce(F.col("ab") <= F.col("bd"), F.lit(True)) & F.coalesce(F.col("bb") <= F.col("ad"), F.lit(True))
    own = (
        twos.where("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), "score")
        .join(dates.toDF("id_a", "ab", "ad"), "id_a").join(dates.toDF("id_b", "bb", "bd"), "id_b")
        .where(agree & in_time).select("id_a", "id_b", "score")
    )

    # 2. Authors with works, by distinct form of the work's name and year.
    shape = ["body", "key", "first", "second", "born", "died", "year"]
    forms = _in_full(works.join(names, "name"), full).select("id", *shape)
    form = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in shape]))
    forms = space.write(forms.withColumn("form", form), "keyed")
    distinct = forms.select(F.col("form").alias("id"), *shape).distinct()
    within = F.coalesce(F.col("b.year") >= F.col("a.born") - WORKS_SLACK, F.lit(True)) & F.coalesce(F.col("b.year") <= F.col("a.died") + WORKS_SLACK, F.lit(True))
    # One bound known: nobody writes more than 90 years after birth or before death.
    within &= F.coalesce(F.col("b.year") <= F.col("a.born") + 90, F.lit(True)) & F.coalesce(F.col("b.year") >= F.col("a.died") - 90, F.lit(True))
    alike = ~_apart(F.col("a.born"), F.col("b.born"), SLACK) & ~_apart(F.col("a.died"), F.col("b.died"), SLACK)
    met = _candidates(lived, distinct, heads).where(within & alike).select(F.col("a.id").alias("author"), F.col("a.born").alias("born"), F.col("b.id").alias("form"), "score").distinct()
    met = space.write(met, "met")
    top = met.groupBy("form").agg(F.max("score").alias("top"))
    lives = met.join(top, "form").where("score >= top - 1").groupBy("form").agg(F.min("born").alias("b0"), F.max("born").alias("b1"))
    kept = met.join(lives, "form").where(f"born is null or b0 is null or born between b0 - {SLACK} and b1 + {SLACK}").select("author", "form", "score")
    theirs = kept.join(forms.select("id", "form"), "form").select(F.least("author", "id").alias("id_a"), F.greatest("author", "id").alias("id_b"), "score")
    return own.unionByName(theirs)
