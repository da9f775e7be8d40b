"""Matching names and records: cascades by priority, fuzzy matches with a margin, link tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_tokens, token_similarity
from ..sources.files import spread
from ..storage import stored


def cascade(rows: DataFrame, key: str, candidates: Sequence[tuple[str, Column]], targets: DataFrame, name: str, target: str) -> DataFrame:
    """Per row key: target and how, by the first candidate (label, value) that equals a target's name.

    Candidates are exploded, so one equi-join serves all of them. Of several targets with a name the least wins.
    """
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(label).alias("how"), value.cast("string").alias("value")) for k, (label, value) in enumerate(candidates)])
    exploded = rows.select(F.col(key), F.explode(tries).alias("x")).where("x.value <> ''")
    there = targets.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.min(target).alias(target))
    hits = exploded.join(there, exploded["x.value"] == there["_name"])
    return hits.groupBy(key).agg(F.min_by(F.struct(F.col(target), F.col("x.how")), F.struct("x.rank", target)).alias("hit")).select(key, f"hit.{target}", "hit.how")


def first_of_list(rows: DataFrame, key: str, names: Column, targets: DataFrame, name: str, target: str, preferred: Column | None = None) -> DataFrame:
    """Per row key: the target of the first of its names that has one; preferred targets first among equals."""
    exploded = rows.select(F.col(key), F.posexplode(names).alias("place", "value"))
    rank = F.when(preferred, 0).otherwise(1) if preferred is not None else F.lit(0)
    # one target for each name, so that the join gives a row for each name of a row at most
    there = targets.where(F.col(name).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.min_by(target, F.struct(rank, target)).alias(target))
    hits = exploded.join(there, exploded["value"] == there["_name"])
    return hits.groupBy(key).agg(F.min_by(target, "place").alias(target))


def nearest_tier(rows: DataFrame, targets: DataFrame, tiers: Sequence[Sequence[str]], target: str, tier: str = "tier") -> DataFrame:
    """rows with the least target of the first tier that has one, and that tier (from 1 on); rows without any keep nulls.

    A tier is the columns in which a row and a target must agree; each is reduced to one target before it is joined.
    """
    found, names = rows, []
    for k, keys in enumerate(tiers, 1):
        side = targets.groupBy(*keys).agg(F.min(target).alias(f"_{k}"))
        found = found.join(side, list(keys), "left")
        names.append(f"_{k}")
    which = reduce(lambda w, x: w.when(F.col(x[1]).isNotNull(), x[0]), list(enumerate(names, 1))[1:], F.when(F.col(names[0]).isNotNull(), 1))
    return found.withColumns({target: F.coalesce(*names), tier: which}).drop(*names)


def _merged(df: DataFrame) -> DataFrame:
    """df for a join by merging. Rows of words and variants are many times the size of their files, by which Spark would send a side to every task, through the driver."""
    return df.hint("merge")


#: Similarity that counts without anything else, and with an equal day; of names as one word, from where on it counts; what is looked for first.
STRONG, WEAK, ALIKE, CLOSE = 0.6, 0.3, 0.8, 0.9
#: Another customer within this of the best total makes a match ambiguous.
MARGIN = 0.2
#: Names of a day are compared in pairs where these are at most so many for each name.
DAY_PAIRS = 50


def _named(rows: DataFrame, name: str, side: str, tokens: str | None = None) -> DataFrame:
    """The distinct names (``side``) with their words (``side``_words, taken from a column where there is one) and the words as one (``side``_one)."""
    if tokens is None:
        words = rows.select(F.col(name).alias(side)).distinct().withColumn(f"{side}_words", name_tokens(side))
    else:
        words = rows.select(F.col(name).alias(side), F.col(tokens).alias(f"{side}_words")).distinct()
    words = words.where(F.size(f"{side}_words") > 0)
    # written, since all that follows asks for the words, and they are costly
    return stored(words.withColumn(f"{side}_one", F.array_join(f"{side}_words", "")), "names")


def _first(names: DataFrame, side: str, items: Column, frequency: DataFrame, length: Column) -> DataFrame:
    """Of each name's items the rarest, as many as length says: (item, side)."""
    exploded = names.select(side, length.cast("int").alias("_keep"), F.explode(items).alias("item")).join(_merged(frequency), "item")
    ranked = exploded.groupBy(side, "_keep").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items"))
    return ranked.select(side, F.explode(F.slice("items", F.lit(1), F.col("_keep"))).alias("x")).select(side, F.col("x.item").alias("item"))


def _sharing(a: DataFrame, b: DataFrame, items: Callable[[Column, Column], Column], length: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of names that share one of the rarest items of each."""
    all_items = a.select(F.explode(items(F.col("a_words"), F.col("a_one"))).alias("item")).union(b.select(F.explode(items(F.col("b_words"), F.col("b_one")))))
    frequency = all_items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    sides = [_first(df, x, items(F.col(f"{x}_words"), F.col(f"{x}_one")), frequency, length(F.col(f"{x}_words"), F.col(f"{x}_one"))) for x, df in (("a", a), ("b", b))]
    return sides[0].join(_merged(sides[1]), "item").select("a", "b")


def _counted(items: Column) -> Column:
    """Items with how often each was there before, so that a set of them counts repeats."""
    return F.transform(items, lambda g, i: F.concat(g, F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == g)).cast("string")))


def bigrams(x: Column) -> Column:
    """Pairs of neighbouring characters, numbered where they repeat; for three characters also the first with the last."""
    counted = _counted(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2))))
    return F.when(F.length(x) < 2, F.array().cast("array<string>")).when(F.length(x) == 3, F.concat(counted, F.array(F.concat(F.substr(x, F.lit(1), F.lit(1)), F.substr(x, F.lit(3), F.lit(1)), F.lit("1"))))).otherwise(counted)


#: Variants that both names of a pair may have together; beyond that pairs are found by their rarest bigrams.
REACH = 1000


def least_common(a: int, b: int, alike: float = ALIKE) -> int:
    """How many of their characters two names of these lengths must have in common, in order, to be so much alike."""
    return math.ceil(alike / 2 * (a + b) - 1e-9)


def within_reach(a: int, b: int, alike: float = ALIKE) -> bool:
    """Whether names of these lengths meet by equal variants; they can't be alike at all where one is too short."""
    n, m = least_common(a, b, alike), least_common(a - 1, b - 1, alike)
    return n <= min(a, b) and math.comb(a, n) + math.comb(b, n) + math.comb(a - 1, m) + math.comb(b - 1, m) <= REACH


def too_far(a: int, b: int, alike: float = ALIKE) -> bool:
    return least_common(a, b, alike) > min(a, b) and least_common(a - 1, b - 1, alike) > min(a, b) - 1


def variants(one: str, lengths: Sequence[int], first: bool, alike: float = ALIKE) -> set[str]:
    """What a name and one of each of these lengths have in common if they are alike: all choices of that many characters or bigrams."""
    n, found = len(one), set()
    pairs = sorted(map("".join, pairwise(one)))
    for m in lengths:
        if within_reach(n, m, alike):
            of = f"{n},{m}" if first else f"{m},{n}"
            found.update(f"c{of}|{''.join(x)}" for x in combinations(one, least_common(n, m, alike)))
            if n > 1 and m > 1 and (k := least_common(n - 1, m - 1, alike)) <= min(n, m) - 1:
                found.update(f"g{of}|{''.join(x)}" for x in combinations(pairs, k))
    return found


def _lengths(names: DataFrame, side: str) -> list[int]:
    """Those of the names as one word; few, whatever the number of names."""
    return sorted(r["n"] for r in names.select(F.length(f"{side}_one").alias("n")).distinct().collect())


def _variants(names: DataFrame, side: str, others: list[int], alike: float = ALIKE) -> DataFrame:
    """(side, variant): what names of the other lengths may have in common with each name."""

    @F.pandas_udf("array<string>")
    def made(one: pd.Series) -> pd.Series:
        return one.map(lambda y: list(variants(y, others, side == "a", alike)))

    return names.select(side, F.explode(made(f"{side}_one")).alias("variant")).select(side, F.xxhash64("variant").alias("variant"))


def _meeting(a: DataFrame, b: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Pairs of names that are alike as one word by so much, and some more."""
    return _variants(a, "a", _lengths(b, "b"), alike).join(_merged(_variants(b, "b", _lengths(a, "a"), alike)), "variant").select("a", "b")


def _some_alike(a: DataFrame, b: DataFrame) -> DataFrame:
    """For names of a up to two names of b that share a variant, hence are alike; there may be more.

    Of the names that have a variant two are kept, so this grows with the names, not with the pairs that are alike.
    """
    number = F.xxhash64("b")
    ends = _variants(b, "b", _lengths(a, "a")).groupBy("variant").agg(F.min(number).alias("low"), F.max(number).alias("high"))
    met = _variants(a, "a", _lengths(b, "b")).join(_merged(ends), "variant").groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    either = met.select("a", F.explode(F.array_distinct(F.array("low", "high"))).alias("number"))
    return either.join(_merged(b.select("b", number.alias("number"))), "number").select("a", "b")


def _farther(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of the lengths that variants don't reach, by one of the rarest bigrams of each."""
    lengths = _lengths(b, "b")
    beyond = [(n, m) for n in _lengths(a, "a") for m in lengths if not within_reach(n, m) and not too_far(n, m)]
    if not beyond:
        return a.select("a").where("false").join(b.select("b"), F.lit(False))
    some = lambda df, x, k: df.where(F.length(f"{x}_one").isin(sorted({p[k] for p in beyond})))
    pairs = _sharing(some(a, "a", 0), some(b, "b", 1), lambda words, one: bigrams(one), lambda words, one: (F.length(one) - F.greatest(F.ceil(F.length(one) / 3 - 1 - 1e-9), F.lit(1)) + 1))
    # written, since these are asked for by every pair
    parts = lambda df, x: stored(df.select(x, f"{x}_one", _counted(F.split(f"{x}_one", "")).alias(f"{x}_characters"), bigrams(F.col(f"{x}_one")).alias(f"{x}_bigrams")), "names")
    own = pairs.distinct().join(_merged(parts(a, "a")), "a").join(_merged(parts(b, "b")), "b")
    both, shared = F.length("a_one") + F.length("b_one"), lambda x: F.size(F.array_intersect(f"a_{x}", f"b_{x}")) + 1e-9
    in_order = (F.levenshtein("a_one", "b_one") <= 0.2 * both + 1e-9) & (shared("characters") >= 0.4 * both)
    return own.where(in_order | (shared("bigrams") >= 0.4 * (both - 2))).select("a", "b")


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of names that are scored: all that are alike by STRONG are among them.

    Names whose words agree by 0.6 share one of the rarest words of each, of which n - ceil(0.6 n) + 1 are taken. Names that are
    alike as one word by 0.8, by edits or common subsequence, have 0.4 (a + b) characters in common, in order; those alike by bigrams 0.4 (a + b - 2) bigrams.
    So they meet in an equal choice of that many: a few for short names, however many characters all names share. For longer
    names choices are too many, but bigrams tell more: there names share 0.2 (a + b) - 1 bigrams at least, so one of the rarest
    a - ceil(a / 3 - 1) of each; common characters, edits and bigrams are counted before such a pair is scored.
    """
    return _by_words(a, b, STRONG).union(_meeting(a, b)).union(_farther(a, b))


def strong_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """left_name, right_name and score of the distinct names that are alike by STRONG or more. Exact, without comparing every pair."""
    a, b = _named(left, left_name, "a"), _named(right, right_name, "b")
    return _scored(a, b, candidates(a, b), least=STRONG).withColumnsRenamed({"a": left_name, "b": right_name})


def _close_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b and score of the names that are alike by CLOSE or more, where variants reach: few choices, and the rarest word of most names."""
    by_words = _by_words(a, b, CLOSE)
    return _scored(a, b, by_words.union(_meeting(a, b, CLOSE)), least=CLOSE)


def _by_words(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    return _sharing(a, b, lambda words, one: words, lambda words, one: F.size(words) - F.ceil(F.size(words) * least - 1e-9) + 1)


def _scored(a: DataFrame, b: DataFrame, pairs: DataFrame, *by: str, least: float) -> DataFrame:
    words = pairs.distinct().join(_merged(a.select("a", "a_words")), "a").join(_merged(b.select("b", "b_words")), "b")
    return stored(words.select("a", "b", *by, token_similarity(F.col("a_words"), F.col("b_words")).alias("score")), "name-pairs").where(F.col("score") >= least)


def weak_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, day: str) -> DataFrame:
    """left_name, right_name, day and score of the names of an equal day (not null) that are alike by WEAK or more, but not by STRONG.

    They share a word, or one holds the other (from four characters on), hence its first four characters.
    """
    a, b = _named(left, left_name, "a"), _named(right, right_name, "b")
    of = lambda df, name, side: df.select(F.col(name).alias(side), F.col(day).alias("day")).where("day is not null").distinct()
    days_a, days_b = of(left, left_name, "a").join(_merged(a), "a"), of(right, right_name, "b").join(_merged(b), "b")
    word = lambda df, side: df.select(side, "day", F.explode(f"{side}_words").alias("item"))
    inside = lambda df, side: df.where(F.length(f"{side}_one") >= 4).select(side, "day", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(f"{side}_one") - 3), lambda i: F.substr(F.col(f"{side}_one"), i, F.lit(4))))).alias("item"))
    start = lambda df, side: df.where(F.length(f"{side}_one") >= 4).select(side, "day", F.substring(f"{side}_one", 1, 4).alias("item"))
    joins = [(word(days_a, "a"), word(days_b, "b")), (inside(days_a, "a"), start(days_b, "b")), (start(days_a, "a"), inside(days_b, "b"))]
    pairs = reduce(DataFrame.union, [x.join(_merged(y), ["day", "item"]).select("a", "b", "day") for x, y in joins])
    found = _scored(a, b, pairs, "day", least=WEAK).where(F.col("score") < STRONG)
    return found.withColumnsRenamed({"a": left_name, "b": right_name, "day": day})


def best_with_margin(candidates: DataFrame, key: str, total: str, rival_group: str, order: Sequence[Column] = (), margin: float = MARGIN) -> DataFrame:
    """Per key the best candidate by total, with status matched, or ambiguous where another group comes within the margin."""
    by = Window.partitionBy(key).orderBy(F.desc(total), *order)
    ranked = candidates.withColumn("_rank", F.row_number().over(by)).withColumn("_best", F.first(rival_group).over(by))
    rival = F.max(F.when((F.col("_rank") > 1) & ~F.col(rival_group).eqNullSafe(F.col("_best")), F.col(total))).over(Window.partitionBy(key))
    top = ranked.withColumn("_rival", rival).where("_rank = 1")
    status = F.when(F.col(total) - F.col("_rival") < margin, "ambiguous").otherwise("matched")
    return top.withColumn("status", status).drop("_rank", "_best", "_rival")


def customers(orders: DataFrame) -> DataFrame:
    """One row for each customer of orders (email, name, date, number): names and dates as sets, orders by date, the last label."""
    from ..functions.text import plain_name

    own = orders.withColumn("norm_name", plain_name("name"))
    last = F.struct("date", "number")
    return own.groupBy("email", "norm_name").agg(
        F.sort_array(F.collect_list(F.struct("date", "number"))).alias("orders"),
        F.sort_array(F.collect_set("name")).alias("names"),
        F.sort_array(F.collect_set("date")).alias("dates"),
        F.max_by("name", last).alias("label"),
    )


def fuzzy(subscriptions: DataFrame, customers: DataFrame) -> DataFrame:
    """Subscriptions (sub_id, sub_name, sub_email, start_date) to customers (customer_id, label, email, dates).

    A pair counts by an equal address (similarity 0.3 at least), a similarity of 0.6, or 0.3 with an equal date;
    the best total wins unless another customer comes within 0.2.

    Pairs with an equal address are found by it, pairs with an equal date by it, unless too many names have that date. Other totals
    are 1 at most, so a subscription whose best one is farther from that than the margin is settled. For the others all names that
    are alike by CLOSE are looked for: from then on a best one of CLOSE or more stays the best, and is settled by a rival, or
    if there can't be one any more. A rival is looked for among few names; only what is open after that is looked for among
    all names that are alike by STRONG. No search leaves anything out for good, so the result is that of comparing all.

    Customers of one address and name are no rivals of each other, so the least of them stands for all, and the least of each day.
    """
    address = F.lower(F.trim("sub_email"))
    # the words are costly: dealt to all cores, and written
    subs = stored(spread(subscriptions.select("sub_id", "sub_name", "sub_email", "start_date")).withColumn("left_tokens", name_tokens("sub_name")), "names")
    every = stored(spread(customers.select("customer_id", "label", "email", "dates")).withColumn("right_tokens", name_tokens("label")), "names")
    own = stored(every.groupBy("email", "label", "right_tokens").agg(F.min("customer_id").alias("customer_id")), "customers")
    dated = stored(every.withColumn("start_date", F.explode("dates")).groupBy("start_date", "email", "label", "right_tokens").agg(F.min("customer_id").alias("customer_id")), "dated")
    ends = _two_addresses(own)
    score = token_similarity(F.col("left_tokens"), F.col("right_tokens"))
    same = F.coalesce((address == F.col("email")) & (F.col("email") != ""), F.lit(False))
    best = lambda found: best_with_margin(found, "sub_id", "total", "email", [F.asc("customer_id")])
    without = lambda rows, *gone: reduce(lambda df, x: df.join(_merged(x.select("sub_id").distinct()), "sub_id", "left_anti"), gone, rows)
    by_name = lambda rows, pairs: rows.join(_merged(pairs.withColumnsRenamed({"a": "sub_name", "b": "label"})), "sub_name").join(_merged(ends), "label").select("sub_id", "customer_id", "email", "score", F.col("score").alias("total"))

    mailed = subs.join(_merged(own.where("email <> ''")), address == F.col("email")).withColumn("score", score).where(F.col("score") >= WEAK)
    in_time = mailed.join(_merged(dated.select("email", "label", "start_date", F.col("customer_id").alias("_dated"))), ["email", "label", "start_date"], "left")
    known = stored(in_time.select("sub_id", F.coalesce("_dated", "customer_id").alias("customer_id"), "email", "score", _total(F.col("_dated").isNotNull(), F.lit(True))), "mailed")
    left = stored(without(subs.where(F.size("left_tokens") > 0), known.where(F.col("total") - 1.3 >= MARGIN)), "left")

    count = lambda rows, n: rows.groupBy("start_date").agg(F.count(F.lit(1)).alias(n))
    days = count(left, "n").join(_merged(count(dated, "m")), "start_date").withColumn("few", F.col("n") * F.col("m") <= DAY_PAIRS * (F.col("n") + F.col("m")))
    of_day = left.join(_merged(dated.join(_merged(days.where("few").select("start_date")), "start_date")), "start_date").withColumn("score", score).where(F.col("score") >= WEAK)
    known = known.union(stored(of_day.select("sub_id", "customer_id", "email", "score", _total(F.lit(True), same)), "dated"))
    crowded = left.join(_merged(days.where("not few").select("start_date")), "start_date", "left_semi")

    names = _named(own, "label", "b", "right_tokens")
    length, others = F.length(F.array_join("left_tokens", "")), _lengths(names, "b")
    missed = [r["n"] for r in left.select(length.alias("n")).distinct().collect() if any(not within_reach(r["n"], m, CLOSE) and not too_far(r["n"], m, CLOSE) for m in others)]
    calm = without(left, crowded)
    clear = stored(calm.join(_merged(best(known).select("sub_id", "total")), "sub_id").where(F.col("total") - 1 >= MARGIN).select("sub_id"), "settled")
    near = stored(without(calm.where(~length.isin(missed)), clear), "left")
    known = known.union(stored(by_name(near, _close_pairs(_named(near, "sub_name", "a", "left_tokens"), names)), "close"))

    first = best(known).selectExpr("sub_id", "email as best_email", "total as best_total", f"status = 'ambiguous' or total - {CLOSE}D >= {MARGIN}D as settled").where(F.col("best_total") >= CLOSE)
    first = stored(near.join(_merged(first), "sub_id"), "first")
    doubtful = first.where("not settled")
    a = _named(doubtful, "sub_name", "a", "left_tokens")
    rivals = stored(by_name(doubtful, _scored(a, names, _some_alike(a, names), least=STRONG)), "rivals")
    known = known.union(rivals)
    beaten = doubtful.select("sub_id", "best_email", "best_total").join(_merged(rivals), "sub_id").where(~F.col("email").eqNullSafe(F.col("best_email")) & (F.col("best_total") - F.col("total") < MARGIN))

    unsettled = stored(without(left, clear, first.where("settled"), beaten), "left")
    if not unsettled.isEmpty():
        a = _named(unsettled, "sub_name", "a", "left_tokens")
        strong = _scored(a, names, candidates(a, names), least=STRONG)
        late = unsettled.join(_merged(crowded.select("sub_id")), "sub_id", "left_semi").select("sub_id", "sub_name", "sub_email", "start_date")
        weak = late.join(_merged(weak_pairs(late, dated, "sub_name", "label", "start_date")), ["sub_name", "start_date"])
        of_day = weak.unionByName(late.join(_merged(strong.withColumnsRenamed({"a": "sub_name", "b": "label"})), "sub_name")).join(_merged(dated.drop("right_tokens")), ["label", "start_date"])
        known = known.union(by_name(unsettled, strong)).union(of_day.select("sub_id", "customer_id", "email", "score", _total(F.lit(True), same)))
    return subscriptions.select("sub_id").join(_merged(best(known).select("sub_id", "customer_id", "score", "total", "status")), "sub_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))


def _total(same_date: Column, same_email: Column) -> Column:
    return (F.col("score") + F.when(same_date, 0.3).otherwise(0) + F.when(same_email, 1).otherwise(0)).alias("total")


def _two_addresses(customers: DataFrame) -> DataFrame:
    """Of the customers of a label the least one, and the least of another address: one of them is the best rival of any address."""
    own = F.struct("customer_id", "email")
    first = customers.groupBy("label").agg(F.min(own).alias("_first"))
    others = customers.join(_merged(first), "label").where(~F.col("email").eqNullSafe(F.col("_first.email")))
    both = first.union(others.groupBy("label").agg(F.min(own)))
    return stored(both.select("label", "_first.customer_id", "_first.email"), "customers")


def through_links(points: DataFrame, links: DataFrame, routes: DataFrame) -> DataFrame:
    """(point_id, route_id) by a link table of old ids and the routes' slugs, each once."""
    return links.join(points.select("old_point_id", "point_id"), "old_point_id").join(routes.select("slug", "route_id"), "slug").select("point_id", "route_id").distinct()


def parents(rows: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """rows with a parent only where it exists and is another row."""
    there = rows.select(F.col(key).alias("_there")).distinct()
    found = rows.join(there, rows[parent] == there["_there"], "left")
    return found.withColumn(parent, F.when(F.col("_there") != F.col(key), F.col("_there"))).drop("_there")


def subsequence_at(whole: Column, part: Column) -> Column:
    """Where an array first holds another one in a row, from 0; null if nowhere."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(whole) - F.size(part), F.lit(0))), lambda i: F.slice(whole, i + 1, F.size(part)) == part)
    return F.when(F.size(part) > 0, F.get(starts, F.lit(0)))
