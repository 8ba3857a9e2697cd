"""Addresses that denote one location: top-down linking of regions, towns, streets and house numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.addresses import Address, postal_code, read_address
from recordweave.llm.names import edits, other_word
from recordweave.llm.pairs import pairs_within
from recordweave.llm.segments import similar
from recordweave.operators.components import components
from recordweave.runtime import by_key, cut, identity, spread

PARSED = "address string, clean boolean, reading int, number string, street string, unit string, kind string, rest string, first string, last string, postal string, grams array<string>"


def _runs(words: tuple) -> list[list[str]]:
    parts: list[list[str]] = [[]]
    for w in words:
        if w is None:
            parts.append([])
        else:
            parts[-1].append(w)
    return [p for p in parts if p]


def parse(addresses: DataFrame) -> DataFrame:
    """Parts of distinct addresses, in one or two readings. rest holds all words that are not the street's; first and last
    are its outer parts where it has two or more (town and region of a clean address), grams its runs of up to three words.
    street and grams are in the spelling of sounds, and also as typed where that differs (street: behind a space)."""

    def row(a: str, clean: bool, n: int, x: Address) -> tuple:
        parts = _runs(x.rest)
        grams = {" ".join(p[i : i + k]) for p in [*parts, *_runs(x.plain)] for k in (1, 2, 3) for i in range(len(p) - k + 1)}
        street = x.street if x.typed == x.street else f"{x.street} {x.typed}"
        return (a, clean, n, x.number, street or None, x.unit, x.kind, ", ".join(" ".join(p) for p in parts), " ".join(parts[0]) if parts else None, " ".join(parts[-1]) if len(parts) > 1 else None, x.postal, sorted(grams))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for a, clean in zip(b.address, b.clean, strict=True):
                x = read_address(a)
                rows.append(row(a, clean, 0, x))
                if x.other:
                    rows.append(row(a, clean, 1, x.other._replace(unit=x.unit)))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return addresses.mapInPandas(run, PARSED)


def settled(parsed: DataFrame) -> DataFrame:
    """parsed with one reading of each address: the one whose street stands in clean addresses, else the first."""
    streets = parsed.filter("clean and reading = 0 and street is not null").select("street").distinct().withColumn("known", F.lit(1))
    all_ = parsed.join(by_key(streets), "street", "left")
    best = F.max_by(F.struct(*parsed.columns), F.struct(F.coalesce("known", F.lit(0)), -F.col("reading")))
    return all_.groupBy("address").agg(best.alias("x")).select("x.*")


def gazetteer(parsed: DataFrame) -> DataFrame:
    """(name, town, within, region_id) of the names in clean addresses, top down: a name can be a region's, a town's, or both.

    A region is what stands last behind a town. Its short form (first and last letter of the words, as MH) is linked to the
    long form where both stand behind one and the same town: region_id is the long form. within has the regions that a town
    stands in, none if it stands alone.
    """
    both = cut(parsed.filter("clean and first is not null").groupBy("first", "last").agg(F.count(F.lit(1)).alias("n")))
    known = both.filter("last is not null")
    x = known.select("first", F.col("last").alias("long")).filter("length(long) > 2")
    y = known.select("first", F.col("last").alias("short")).filter("length(short) = 2")
    letters = F.concat(F.substring("long", 1, 1), F.expr("right(long, 1)"))
    # the spelling shared by sounds may end differently: valley reads vale
    alike = x.join(by_key(y), "first").filter((F.col("short") == letters) | (F.substring("short", 1, 1) == F.substring("long", 1, 1)) & F.col("long").rlike(r" val[ei]$| pradesh$"))
    pick = alike.groupBy("short", "long").agg(F.count(F.lit(1)).alias("n")).groupBy("short").agg(F.min_by("long", F.struct(-F.col("n"), "long")).alias("long"))
    regions = known.select("last").distinct().join(by_key(pick.withColumnRenamed("short", "last")), "last", "left").select("last", F.coalesce("long", "last").alias("region_id"))
    regions = cut(regions)
    towns = both.join(by_key(regions), "last", "left").groupBy(F.col("first").alias("name")).agg(F.collect_set("region_id").alias("within"))
    named = towns.join(by_key(regions.withColumnRenamed("last", "name")), "name", "full_outer")
    return cut(named.select("name", F.col("within").isNotNull().alias("town"), F.coalesce("within", F.array().cast("array<string>")).alias("within"), "region_id"))


def place_words(parsed: DataFrame, named: DataFrame) -> DataFrame:
    """(rest, towns) of distinct rests: the towns that the words can mean, in the regions that they name.

    Words are matched exactly, towns else with one edit (two from nine letters on). Towns outside of a region that the words
    name are dropped; without a region all towns of the name stay. Several candidates are all kept.
    """
    rests = cut(parsed.filter("rest != ''").select("rest", F.explode("grams").alias("gram")).distinct())
    k = F.when(F.length("s") >= 9, 2).otherwise(1)
    towns = named.filter("town")
    i = towns.select(F.col("name").alias("id"), F.col("name").alias("s"), F.lit(0).alias("bucket")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    unknown = rests.select("gram").distinct().filter("length(gram) > 3").join(by_key(towns.select(F.col("name").alias("gram"))), "gram", "left_anti")
    p = unknown.select(F.col("gram").alias("id"), F.col("gram").alias("s"), F.lit(0).alias("bucket")).withColumn("k", k)
    near = similar(i, p).filter("distance > 0 and length(a) > 4").select(F.col("a").alias("name"), F.col("b").alias("gram"), "distance")
    near = near.join(by_key(towns), "name").select("gram", "name", "town", "within", F.lit(None).cast("string").alias("region_id"), "distance")
    exact = named.select(F.col("name").alias("gram"), "name", "town", "within", "region_id", F.lit(0).alias("distance"))
    meant = rests.join(by_key(near.unionByName(exact)), "gram").groupBy("rest").agg(F.collect_set("region_id").alias("regions"), F.collect_set(F.when(F.col("town"), F.struct("name", "within", "distance"))).alias("towns"))
    # a region's name that is also a town's isn't the town where another town is named
    r = F.col("regions")
    fits = F.filter("towns", lambda t: (F.size(r) == 0) | (F.size(t["within"]) == 0) | F.arrays_overlap(t["within"], r) | F.array_contains(r, t["name"]))
    scored = F.transform(fits, lambda t: F.struct(t["name"].alias("name"), (t["distance"] + F.when(F.array_contains(r, t["name"]), 3).otherwise(0)).alias("score")))
    best = F.array_min(F.transform("scored", lambda t: t["score"]))
    meant = meant.withColumn("scored", scored)
    return meant.select("rest", F.array_distinct(F.transform(F.filter("scored", lambda t: t["score"] == best), lambda t: t["name"])).alias("towns"))


def _same_street(a: pd.Series, b: pd.Series) -> pd.Series:
    one = lambda x, y: edits(x, y, 2) <= (2 if min(len(x), len(y)) > 8 else 1) and not other_word(x, y)
    return pd.Series([any(one(x, y) for x in xs.split() for y in ys.split()) for xs, ys in zip(a, b, strict=True)])


def _alike(streets: DataFrame) -> DataFrame:
    """(a, b): ids, in one bucket, whose streets are one street's name, misspelt or not; not an id with itself. streets has id, street, bucket, asks and wide.

    Only rows that ask are looked up; those that aren't wide are found from the longer name, as both ask.
    """
    k = F.when(F.length("s") >= 9, 2).otherwise(1)
    i = streets.select("id", F.explode(F.split("street", " ")).alias("s"), "bucket", "asks", "wide")
    near = similar(i.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), i.filter("asks").withColumn("k", k)).filter("a != b").select("a", "b")
    name = lambda x: by_key(streets.select(F.col("id").alias(x), F.col("street").alias(f"s{x}")))
    near = near.join(name("a"), "a").join(name("b"), "b").filter(F.pandas_udf(_same_street, "boolean")("sa", "sb")).select("a", "b")
    return cut(near)


def locate(records: DataFrame, clean: DataFrame) -> DataFrame:
    """(address, postal, location, unit): records' distinct (address, postal) pairs with the id of their location.

    Levels from the top: the region words, then the town words of each address are resolved against those of `clean`; streets
    are compared within one town; equal numbers in linked streets are one location. Links are made between places (town,
    street, number) and from an address to its places, never between all addresses of a place. An address without a town
    inherits the places of its street and number in any town: it is of that location if there is just one, or just one with
    its postal code; else it stays ambiguous, alone with its like. Addresses of which no town is known at all are
    linked among themselves. Addresses without number or street have no row. unit is the level below, as written; it
    doesn't part locations.
    """
    own = records.select("address", "postal").filter("trim(address) != ''").distinct()
    texts = own.select("address", F.lit(False).alias("clean")).unionByName(clean.select("address", F.lit(True).alias("clean"))).groupBy("address").agg(F.max("clean").alias("clean"))
    parsed = cut(settled(cut(parse(spread(texts, "address")))))
    placed = place_words(parsed, gazetteer(parsed))
    code = F.pandas_udf(lambda s: s.map(postal_code, na_action="ignore").astype(object), "string")
    full = own.withColumn("delivered", code("postal")).join(by_key(parsed.withColumnRenamed("postal", "written").filter("number is not null and street is not null")), "address")
    full = full.join(by_key(placed), "rest", "left")
    full = full.select("address", "postal", "number", "street", "unit", F.array_sort(F.coalesce("towns", F.array().cast("array<string>"))).alias("towns"), F.substring(F.coalesce("written", "delivered"), 1, 5).alias("code"))
    same = identity("number", "street", F.array_join("towns", "|"), F.when(F.size("towns") == 0, F.coalesce("code", F.lit(""))).otherwise(""))
    full = cut(full.withColumn("key", same))
    # numbers for nodes, places and streets are written once, so that a retried task can't number them anew
    nodes = cut(full.groupBy("key").agg(*[F.first(c).alias(c) for c in ("number", "street", "towns")], F.collect_set("code").alias("codes")).withColumn("node", 2 * F.monotonically_increasing_id()))
    # towns, then the streets in them, then the numbers in these; an address without a town stands at its street and number in any town
    at = nodes.select(F.struct("node", "codes").alias("node"), "number", "street", F.explode_outer("towns").alias("town"))
    places = at.groupBy("town", "number", "street").agg(F.collect_set("node").alias("nodes"))
    places = cut(places.withColumn("place", 2 * F.monotonically_increasing_id() + 1))
    whole = places.select(F.lit("town").alias("kind"), F.col("town").alias("bucket"), "street", F.lit(True).alias("asks"), F.lit(False).alias("wide")).filter("bucket is not null")
    any_ = places.select(F.lit("number").alias("kind"), F.col("number").alias("bucket"), "street", F.col("town").isNull().alias("asks"), F.lit(True).alias("wide"))
    streets = whole.unionByName(any_).groupBy("kind", "bucket", "street").agg(F.max("asks").alias("asks"), F.max("wide").alias("wide"))
    streets = cut(streets.withColumn("id", F.monotonically_increasing_id()))
    close = _alike(streets.withColumn("bucket", F.concat("kind", F.lit("|"), "bucket")))
    of = lambda kind, *names: by_key(streets.filter(F.col("kind") == kind).select("street", F.col("bucket").alias(kind), F.col("id").alias(names[0])))
    located = places.filter("town is not null").join(of("town", "id"), ["town", "street"])
    there = lambda x, y: by_key(located.select(F.col("id").alias(x), "number", F.col("place").alias(y)))
    linked = close.join(there("a", "pa"), "a").join(there("b", "pb"), ["b", "number"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    # without a town: the same street and number in all towns
    numbered = cut(places.join(of("number", "id"), ["number", "street"]).select("id", "place", F.explode("nodes").alias("n"), F.col("town").isNull().alias("open")).select("id", "place", "n.node", "n.codes", "open"))
    ids = numbered.filter("open").select("id").distinct()
    reach = ids.select(F.col("id").alias("a"), F.col("id").alias("b")).unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")).join(by_key(ids.withColumnRenamed("id", "a")), "a", "left_semi")).distinct()
    reach = cut(reach)
    known = numbered.filter("not open").select(F.col("id").alias("b")).distinct()
    able = reach.join(by_key(known), "b", "left_semi").select(F.col("a").alias("id")).distinct()
    lost = cut(numbered.filter("open").join(by_key(able), "id", "left_anti").select("id", "place", "node"))
    # no town is known for the street and number: linked among themselves
    strays = lost.select("id", "place").distinct()
    among = reach.filter("a != b").join(by_key(strays.select(F.col("id").alias("a"), F.col("place").alias("pa"))), "a").join(by_key(strays.select(F.col("id").alias("b"), F.col("place").alias("pb"))), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    members_ = places.filter("town is not null").select(F.col("place").alias("a"), F.explode("nodes.node").alias("b")).unionByName(lost.select(F.col("place").alias("a"), F.col("node").alias("b")))
    joined = components(linked.unionByName(among).unionByName(members_))
    sure = cut(numbered.filter("not open").select("id", "node", "codes").distinct().join(by_key(joined), "node").select(F.col("id").alias("b"), "codes", F.col("component").alias("c0")))
    few = reach.join(by_key(sure.groupBy("b").agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"))), "b").groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    asked = cut(numbered.filter("open").select(F.col("id").alias("a"), "node", "codes").join(by_key(few), "a"))
    by_code = sure.select("b", F.explode("codes").alias("code"), "c0").distinct()
    coded = asked.filter("lo != hi").select("a", "node", F.explode("codes").alias("code")).join(by_key(reach), "a").join(by_key(by_code), ["b", "code"]).groupBy("node").agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"))
    inherit = asked.select("node", "lo", "hi").unionByName(coded).filter("lo = hi").select("node", F.col("lo").alias("component"))
    final = nodes.select("key", "node").join(by_key(joined.unionByName(inherit)), "node", "left").select("key", F.coalesce("component", "node").alias("location"))
    return full.join(by_key(final), "key").select("address", "postal", "location", "unit")


def members(records: DataFrame, record: str = "entity_id", address: str = "business_address", clean: DataFrame | None = None) -> DataFrame:
    """(id, location) of every record with a readable address. clean: the records whose addresses are written in order, else those of records."""
    r = records.select(F.col(record).alias("id"), F.col(address).alias("address"), "postal").filter("id is not null and trim(address) != ''").distinct()
    c = (records if clean is None else clean).select(F.col(address).alias("address")).filter("trim(address) != ''")
    found = locate(r, c).withColumnRenamed("address", "_a").withColumnRenamed("postal", "_p")
    return cut(r.join(by_key(found), (r["address"] == found["_a"]) & r["postal"].eqNullSafe(found["_p"])).select("id", "location").distinct())


def location_classes(records: DataFrame, record: str = "entity_id", address: str = "business_address", clean: DataFrame | None = None) -> DataFrame:
    """(entity_id, location, n_links): per record its location, named by the smallest id there, and how many other records are there."""
    m = members(records, record, address, clean)
    per = m.groupBy("location").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return m.join(by_key(per), "location").select(F.col("id").alias("entity_id"), F.col("first").alias("location"), (F.col("n") - 1).alias("n_links"))


def location_pairs(records: DataFrame, record: str = "entity_id", address: str = "business_address", clean: DataFrame | None = None) -> DataFrame:
    """(entity_id_a, entity_id_b): records at one location, a < b. See locate.

    Null and blank addresses take no part; a record given twice counts once. Pairs are made on salted keys, so that a
    crowded location is spread over tasks.
    """
    p = pairs_within(members(records, record, address, clean), "location", "id")
    return p.select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b")).distinct()
