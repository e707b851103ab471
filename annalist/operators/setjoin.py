"""Set-similarity joins of names, exact, by a filter on the rarest tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.texts import FULL, ascii_lower, token_set
from annalist.operators.order import numbered
from annalist.storage import Workspace, pick

PROPOSE = 36045


def prefixes(tokens: DataFrame, threshold: int = PROPOSE) -> DataFrame:
    """id, token: the rarest tokens of each set, so many that two sets similar enough must share one.

    tokens: id and its array of distinct tokens. Rarity is the number of sets a token stands in, ties by the token.
    """
    each = tokens.select("id", F.explode("tokens").alias("token"), F.size("tokens").alias("n"))
    often = each.groupBy("token").agg(F.count("*").alias("df"))
    ranked = each.join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"), F.first("n").alias("n"))
    needed = F.ceil(F.lit(threshold) * F.col("n") / FULL)
    keep = F.least(F.greatest(F.col("n") - needed + 1, F.lit(1)), F.col("n")).cast("int")
    return ranked.select("id", F.explode(F.slice("r.token", F.lit(1), keep)).alias("token"))


def _keys(sets: DataFrame, threshold: int) -> DataFrame:
    """k, width, id, n, least, most, twin, ranks: what a set of n tokens is met by, and the sizes of the sets it may meet there.

    sets: id, ranks (its tokens as their places by rarity, in order). Two sets of n and m tokens are similar enough if
    they share threshold * (n + m) / (FULL + threshold) tokens or more, so their first two in common are among the
    first n + 2 less that number. Only where one token is enough is a set met by single tokens.
    """
    threshold = max(threshold, 1)
    both = FULL + threshold
    # Of so many tokens together one in common is enough.
    few = both // threshold
    n = F.size("ranks").cast("long")
    # The second token at place j (from 0) may be the second in common with a set of up to so many tokens.
    pairs = F.flatten(F.transform("ranks", lambda b, j: F.transform(F.slice("ranks", 1, j), lambda a: F.struct((F.shiftleft(a, 32) + b).alias("k"), F.lit(2).alias("width"), F.lit(few + 1).cast("long").alias("from"), F.floor((n + 1 - j) * both / F.lit(threshold)).cast("long").alias("to")))))
    keys = pairs
    if few > 2:
        keys = F.concat(F.transform("ranks", lambda a: F.struct(a.alias("k"), F.lit(1).alias("width"), F.lit(0).cast("long").alias("from"), F.lit(few).cast("long").alias("to"))), pairs)
    each = sets.select("id", "ranks", n.alias("n"), F.inline(keys))
    least = F.greatest(F.ceil(F.col("n") * threshold / FULL), F.col("from") - F.col("n"))
    most = F.least(F.floor(F.col("n") * FULL / threshold), F.col("to") - F.col("n"))
    # Two distinct sets of one size have one token less in common.
    return each.select("k", "width", "id", "n", least.cast("long").alias("least"), most.cast("long").alias("most"), (2 * threshold * F.col("n") <= (F.col("n") - 1) * both).alias("twin"), "ranks").where("least <= most")


def similar_pairs(names: DataFrame, id: str, name: str, threshold: int = PROPOSE) -> DataFrame:
    """left, right (left < right) and score of all pairs of rows whose token sets are similar enough.

    Equal token sets are compared once, by their representative; the result lists the pairs of distinct sets'
    representatives and those of a representative with the copies of its set. Distinct sets meet under the pairs of
    their rarest tokens, with the sizes that leave room for enough in common, each pair of sets under its first two.
    """
    space = Workspace(names.sparkSession, "similar")
    sets = space.write(pick(names, id=id, name=name).select("id", token_set(F.col("name")).alias("tokens")).where("size(tokens) > 0"), "sets")
    reps = space.write(sets.groupBy("tokens").agg(F.min("id").alias("id")), "reps")
    each = reps.select("id", F.explode("tokens").alias("token"))
    places = numbered(each.groupBy("token").agg(F.count("*").alias("df")), [F.col("df"), F.col("token")], "rank", space)
    keys = _keys(each.join(places.select("token", "rank"), "token").groupBy("id").agg(F.array_sort(F.collect_list("rank")).alias("ranks")), threshold)
    keys = space.write(keys, "keys")
    l, r = keys.alias("l"), keys.alias("r")
    sizes = "l.k = r.k and l.width = r.width and (l.n < r.n or (l.n = r.n and l.id < r.id and l.twin)) and r.n between l.least and l.most and l.n between r.least and r.most"
    met = l.join(r.hint("merge"), F.expr(sizes)).select("l.k", "l.width", F.col("l.id").alias("a"), F.col("r.id").alias("b"), (F.col("l.n") + F.col("r.n")).alias("n"), F.col("l.ranks").alias("x"), F.col("r.ranks").alias("y"))

    def judged(common):
        size = F.size(common).cast("long")
        first = F.when(F.col("width") == 2, F.shiftleft(F.get(common, F.lit(0)), 32) + F.get(common, F.lit(1))).otherwise(F.get(common, F.lit(0)))
        return F.struct(F.floor(size * FULL / (F.col("n") - size)).cast("long").alias("score"), first.alias("first"))

    # As rows of an array, so that what is common is found once for each pair and not in each condition.
    found = F.filter(F.transform(F.array(F.array_intersect("x", "y")), judged), lambda j: (j["score"] >= threshold) & (j["first"] == F.col("k")))
    scored = met.select("a", "b", F.inline(found)).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "score")
    copies = sets.join(reps.withColumnRenamed("id", "rep"), "tokens").where("id <> rep").select(F.col("rep").alias("left"), F.col("id").alias("right"), F.lit(FULL).cast("long").alias("score"))
    return scored.unionAll(copies)


def abbreviations(names: DataFrame, id: str, name: str, most_bytes: int = 8) -> DataFrame:
    """short, long: one-word names of few bytes whose letters are initials of another name's words, in order.

    Joined by the first two letters against the ordered pairs of initials, then checked in full.
    """
    every = pick(names, id=id, name=name).where("name is not null")
    words = F.filter(F.split(F.regexp_replace(ascii_lower(F.col("name")), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    every = every.withColumn("initials", F.transform(words, lambda w: F.substring(w, 1, 1)))
    letters = F.regexp_replace(ascii_lower(F.col("name")), "[^a-z0-9]", "")
    short = every.where((F.size("initials") == 1) & (F.octet_length("name") <= most_bytes) & (F.length(letters) >= 2)).select(F.col("id").alias("short"), letters.alias("s"))
    # Of a longer name its initials and the number of its words tell all.
    long = every.where(F.size("initials") > 1).select(F.col("id").alias("long"), "initials", F.size(token_set(F.col("name"))).alias("n"))
    ahead = F.flatten(F.transform("initials", lambda c, i: F.transform(F.slice("initials", i + 2, F.size("initials")), lambda d: F.concat(c, d))))
    kinds = long.select("initials", "n").distinct().withColumn("k", F.explode(F.array_distinct(ahead)))
    taken = F.aggregate("initials", F.lit(0), lambda i, c: F.when(F.substring(F.col("s"), i + 1, F.lit(1)) == c, i + 1).otherwise(i))
    fit = short.select("s", F.substring("s", 1, 2).alias("k")).distinct().join(kinds, "k").where((F.col("n") >= F.length("s")) & (taken == F.length("s"))).select("s", "initials", "n")
    return short.join(fit, "s").join(long, ["initials", "n"]).select("short", "long")
