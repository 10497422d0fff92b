"""Entities of the map: their names and keys, search queries, seeds, links that identify them, ancestors that vouch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_holdout
from .joins import below

#: All words that an institution's account may put beside its name.
BESIDE = (
    "official officials offl college colleges coll clg engg engineering institute institution inst university univ school campus dept department cse ece eee ise mech mechanical civil it ai aiml ds mba mca bba bca bcom bsc msc "
    "mtech btech phd pu puc nss ncc iste ieee csi acm sae ecell alumni association placements placement tpo admissions admission library sports fest club clubs students student council union hostel events news media page "
    "team research innovation cell hub links community india online live tv channel updates group trust math mutt hospital medical nursing pharmacy law arts science commerce high primary english public international residential "
    "the of and for at ac edu org com net in co gov res www company showcase u r c user"
).split()


def entity_key(name: Column) -> Column:
    """A name in small letters and digits without bracketed short forms and 'and'."""
    bare = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"\band\b|&", " "), "[^a-z0-9]", "")


def names_entity(name: Column, handle: Column, title: Column, locations: list[str] | None = None) -> Column:
    """Whether a handle or display name is the entity's name alone, or beside words of institutions and places only.

    Words beside the name may be glued to it where they have three letters or more and the name four.
    """
    allowed = [*BESIDE, *(w.lower() for place in locations or [] for w in place.split())]
    loose, glued = "|".join(sorted(allowed, key=len, reverse=True)), "|".join(sorted((w for w in allowed if len(w) >= 3), key=len, reverse=True))
    words = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    own = words(name)
    token = F.replace(own, F.lit(" "))
    display = F.regexp_replace(title, r"(?i)\s+\(@.*$|\s+[•|·-]\s+.*$|\s+on\s+(?:instagram|facebook|x|linkedin|youtube)\b.*$", "")
    some = F.lit(False)
    for said in (words(handle), words(display)):
        rest = F.replace(F.concat(F.lit(" "), said, F.lit(" ")), F.concat(F.lit(" "), own, F.lit(" ")), F.lit(" "))
        apart = (rest != F.concat(F.lit(" "), said, F.lit(" "))) & F.trim(rest).rlike(rf"^((?:{loose}|[0-9]+)( |$))*$")
        sides = F.split(F.replace(F.replace(said, F.lit(" "), F.lit("_ _")), token, F.lit("\x00")), "\x00")
        left, right = F.replace(F.get(sides, F.lit(0)), F.lit("_ _"), F.lit(" ")), F.replace(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), F.lit("_ _"), F.lit(" "))
        piece = rf"^(?:(?:{loose}|[0-9]+) )*(?:(?:{glued}|[0-9]+)*)$"
        after = rf"^(?:(?:{glued}|[0-9]+)*)(?: (?:{loose}|[0-9]+))*$"
        joined = (F.length(token) >= 4) & (F.size(sides) == 2) & left.rlike(piece) & right.rlike(after)
        some |= (token != "") & ((F.replace(said, F.lit(" ")) == token) | apart | joined)
    return F.coalesce(some, F.lit(False))



def search_queries(profiles: DataFrame, terms: str, topics: dict[str, str], most: int = 8, rotation: str = "rotation") -> DataFrame:
    """profiles (name, aliases, location, keywords) with queries: the question's, a third of the places for names, then topics, each once.

    Names and topics take turns by rotation, so that in time all are asked.
    """
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    place = F.trim(F.coalesce("location", F.lit("")))
    first = quoted(F.col("name"))
    joined = lambda *parts: F.trim(F.concat_ws(" ", *parts))
    some = F.size(terms) > 0
    asked = F.when(some, F.array_compact(F.array(joined(first, F.array_join(F.slice(F.col(terms), 1, 4), " ")), F.when(place != "", joined(first, place, F.array_join(F.slice(F.col(terms), 1, 3), " "))))))
    asked = F.coalesce(asked, F.array().cast("array<string>"))
    identity = F.concat(F.array(quoted(joined("name", place))), F.transform("aliases", lambda a: joined(quoted(a), place)), F.transform("keywords", lambda k: joined(first, k)))
    reserved = F.least(F.size(identity), F.lit(max(1, most // 3)))
    chosen = F.when(some, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, topics.values())))
    slots = F.greatest(F.lit(1), most - reserved - F.size(asked))
    n = F.size(chosen)
    shift = F.when(n > 0, F.pmod(F.col(rotation) * slots, n)).otherwise(0).cast("int")
    turned = F.concat(F.slice(chosen, shift + 1, F.greatest(n, F.lit(0))), F.slice(chosen, F.lit(1), shift))
    own = F.size(identity)
    back = F.pmod(F.col(rotation) * reserved, own).cast("int")
    identity = F.concat(F.slice(identity, back + 1, own), F.slice(identity, F.lit(1), back))
    every = F.concat(asked, F.slice(identity, F.lit(1), reserved), F.transform(turned, lambda t: joined(first, t)), F.slice(identity, reserved + 1, own))
    return profiles.withColumn("queries", F.slice(F.array_distinct(every), F.lit(1), F.lit(most)))


def seed_rows(rows: DataFrame, key: str, holdout_percent: int = 20) -> DataFrame:
    """rows (key, group, claimed) with split: holdout by a hash of the key, canary where the claim is a look-alike, else seed; the first of a key counts."""
    one = rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), "line").alias("_row"))
    flat = one.select(key, "_row.*")
    return flat.withColumn("split", F.when(F.col("claimed") == "lookalike", "canary").when(in_holdout(F.col(key), holdout_percent), "holdout").otherwise("seed"))


def ranked_entities(entities: DataFrame) -> DataFrame:
    """Entities with place: own ones first, then those under an own one, then others; look-alikes are left out; by name."""
    level = F.when(F.col("kind") == "self", 0).when(F.col("under_self"), 1).otherwise(2)
    kept = entities.where("kind <> 'lookalike'").withColumn("level", level)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("name", "entity_id")))


def candidate_pages(links: DataFrame, own: Column, most: int) -> DataFrame:
    """The first most pages of each site (site, target, position) that may say who it is: contact, about and imprint pages of its own, each once."""
    wanted = F.lower(F.concat_ws(" ", "target", "label")).rlike(r"contact|about|imprint|impressum|social|connect")
    rows = links.where(own & wanted).groupBy("site", "target").agg(F.min("position").alias("position"))
    w = Window.partitionBy("site").orderBy("position", "target")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def identity_links(links: DataFrame, platform: Column) -> DataFrame:
    """Links of a page to accounts that stand in its header or footer, or on a page that is about contact: (site, target, area), each once."""
    contact = F.lower("page").rlike("contact|about|connect")
    rows = links.where((platform != "website") & (F.col("area").isin("header", "footer", "nav") | ((F.col("area") == "body") & contact)))
    return rows.groupBy("site", "target").agg(F.min("area").alias("area"))


def reconfirmed(links: DataFrame, unchanged: DataFrame, now: Column) -> DataFrame:
    """The latest supporting link of each asset from a page that has not changed, again, as seen now."""
    last = links.groupBy("asset_id", "page").agg(F.max_by(F.struct("polarity", "detail"), "observed_at").alias("_l"))
    return last.where("_l.polarity = 'supports'").join(unchanged.select("page").distinct(), "page", "left_semi").select("asset_id", "page", F.col("_l.detail").alias("detail"), now.alias("observed_at"))


def claimable(assets: DataFrame, entities: DataFrame, owners: list, kinds: tuple[str, ...]) -> DataFrame:
    """(asset_id, owner): accounts that an owner may confirm: those not placed yet, and those placed with the owner's entity or one below it, at any depth.

    What is placed with an entity of an excluded kind (a look-alike, a person's role) nobody may claim; such an entity on the way up bars nothing.
    """
    root = assets.sparkSession.createDataFrame([(o,) for o in owners], "root long").select(F.col("root").cast(entities.schema["entity_id"].dataType).alias("root"))
    under = below(entities, root, "entity_id", "parent_id").select(F.col("node").alias("entity_id"), F.col("root").alias("owner"))
    open_ = entities.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).select("entity_id")
    placed = assets.select("asset_id", "entity_id").join(open_, "entity_id").join(under, "entity_id").select("asset_id", "owner")
    free = assets.where("entity_id is null").select("asset_id", F.explode(F.array(*map(F.lit, owners))).alias("owner"))
    return placed.unionByName(free.withColumn("owner", F.col("owner").cast(placed.schema["owner"].dataType)))
