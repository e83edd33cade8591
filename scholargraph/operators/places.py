"""Coordinates of items from markers, properties or a gazetteer."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.text import fold, is_blank, strip_ws
from scholargraph.session import cut_lineage

LAT_PROP = "geo:lat"
LNG_PROP = "geo:long"


def norm_text(c) -> Column:
    """Folded, trimmed, inner whitespace collapsed to one space."""
    return F.regexp_replace(strip_ws(fold(c)), r"\s+", " ")


_KEY = ["_pc", "_tw", "_st"]
#: Length of the substrings that street names are compared by.
_GRAM = 2


def _grams(df: DataFrame) -> DataFrame:
    """Every gram of a street with its number among equal ones, so that none repeats in a street."""
    padded = F.concat(F.lit("\u0001"), F.col("_st"), F.lit("\u0002"))
    cut = F.transform(F.sequence(F.lit(1), F.char_length("_st") + 1), lambda i: F.substring(padded, i, F.lit(_GRAM)))
    each = df.select(*_KEY, F.explode(cut).alias("gram")).groupBy(*_KEY, "gram").agg(F.count(F.lit(1)).alias("n"))
    return each.select(*_KEY, F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.col("gram"), i.alias("i")))).alias("gram"))


def _rarest(grams: DataFrame, frequency: DataFrame, size: int) -> DataFrame:
    """The ``size`` grams of each street that fewest streets have."""
    ranked = grams.join(frequency, "gram", "left").select(*_KEY, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    first = F.slice(F.array_sort(F.collect_list("g")), 1, size)  # a street's own grams
    return ranked.groupBy(*_KEY).agg(first.alias("g")).select(*_KEY, F.explode("g").alias("g")).select(*_KEY, F.col("g.gram").alias("gram"))


def _shortened(df: DataFrame, edits: int) -> DataFrame:
    """Streets of few characters with up to ``edits`` of them left out."""
    kept = F.array(F.col("_st"))
    for _ in range(edits):
        kept = F.array_distinct(F.flatten(F.transform(kept, lambda w: F.concat(F.array(w), F.transform(
            F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))))))
    return df.select(*_KEY, F.explode(kept).alias("gram"))


def near_streets(addresses: DataFrame, streets: DataFrame, max_edits: int = 2) -> DataFrame:
    """The nearest street of the same postcode and town for each address, at
    most ``max_edits`` edits away (Levenshtein distance of normalised names).

    ``addresses(_pc, _tw, _st)`` different ones, ``streets(_pc, _tw, _st, lat,
    lng, label)``. Of two names that near, the ``2 * max_edits + 1`` rarest
    2-grams of one and of the other have one in common (an edit changes two), so
    names meet in an equi-join on (postcode, town, gram); only names too short
    for that, both of less than ``2 * max_edits`` characters, meet by what is left
    when characters go. An address is never paired with all streets of its town.
    Output ``(_pc, _tw, _st, lat, lng, label, edits)``, ties to the smaller label.
    """
    towns = addresses.select("_pc", "_tw").distinct()
    there = streets.join(towns, ["_pc", "_tw"], "left_semi")
    names = there.select(*_KEY).distinct()
    theirs, ours = cut_lineage(_grams(names), "street-grams"), _grams(addresses)
    frequency = theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    size = _GRAM * max_edits + 1
    short = F.char_length("_st") < _GRAM * max_edits
    left = _rarest(ours, frequency, size).unionByName(_shortened(addresses.where(short), max_edits).withColumn("gram", _short_key()))
    right = _rarest(theirs, frequency, size).unionByName(_shortened(names.where(short), max_edits).withColumn("gram", _short_key()))
    right = right.withColumnRenamed("_st", "_near")
    met = left.join(right, ["_pc", "_tw", "gram"]).where(F.abs(F.char_length("_st") - F.char_length("_near")) <= max_edits)
    met = met.select("_pc", "_tw", "_st", "_near").distinct().withColumn("edits", F.levenshtein("_st", "_near", max_edits)).where(F.col("edits") >= 0)
    best = F.min(F.struct("edits", "label", "lat", "lng")).alias("_b")
    found = met.join(there.withColumnRenamed("_st", "_near"), ["_pc", "_tw", "_near"])
    return found.groupBy(*_KEY).agg(best).select(*_KEY, "_b.lat", "_b.lng", "_b.label", "_b.edits")


def _short_key() -> Column:
    """A gram that no gram of a street equals: it has the number 0."""
    return F.struct(F.col("gram"), F.lit(0).alias("i"))


def geocode(addresses: DataFrame, gazetteer: DataFrame, max_edits: int = 0) -> DataFrame:
    """Best gazetteer point for each address.

    ``addresses(item_id, street, postcode, town)``; ``gazetteer(street,
    postcode, town, lat, lng, label)`` (town-level rows have no street).
    Both sides are folded and whitespace-normalised. First an equi-join
    on (street, postcode, town), the closest raw street by Levenshtein
    distance winning among equal keys; with ``max_edits`` above 0, addresses
    left over take the nearest street of their town within that many edits
    (``near_streets``); what is still left joins the town-level row of its
    (postcode, town). No pairs of an address with every street of its town are
    formed. Output ``(item_id, lat, lng, label, level)``, level ``street``,
    ``near`` or ``town``; addresses with no match are absent.
    """
    a = addresses.select(
        "item_id", F.lower(strip_ws("street")).alias("_raw"),
        norm_text("street").alias("_st"), norm_text("postcode").alias("_pc"), norm_text("town").alias("_tw"),
    )
    g = gazetteer.select(
        F.lower(strip_ws("street")).alias("_graw"), norm_text("street").alias("_st"),
        norm_text("postcode").alias("_pc"), norm_text("town").alias("_tw"), "lat", "lng", "label",
    )
    named = F.col("_st").isNotNull() & (F.col("_st") != "")
    street_rows = g.where(named)
    full = a.where(named).join(street_rows, ["_st", "_pc", "_tw"])
    w = Window.partitionBy("item_id").orderBy(F.levenshtein("_raw", "_graw"), "label", "lat", "lng")
    found = full.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(
        "item_id", "lat", "lng", "label", F.lit("street").alias("level")
    )
    if max_edits:
        found = cut_lineage(found, "street-points")  # read by both steps that follow
        rest = cut_lineage(a.where(named).join(found.select("item_id"), "item_id", "left_anti").drop("_raw"), "unknown-streets")
        near = near_streets(rest.select(*_KEY).distinct(), street_rows.drop("_graw"), max_edits)
        found = found.unionByName(rest.join(near, _KEY).select("item_id", "lat", "lng", "label", F.lit("near").alias("level")))
    towns = g.where(~F.coalesce(named, F.lit(False))).groupBy("_pc", "_tw").agg(
        F.min_by(F.struct("lat", "lng", "label"), F.struct("label", "lat", "lng")).alias("_g")
    )
    rest = a.join(found.select("item_id"), "item_id", "left_anti")
    best_town = rest.join(towns, ["_pc", "_tw"]).select(
        "item_id", F.col("_g.lat").alias("lat"), F.col("_g.lng").alias("lng"), F.col("_g.label").alias("label"),
        F.lit("town").alias("level"),
    )
    return found.unionByName(best_town)


#: Mean radius of the earth in metres.
EARTH_RADIUS = 6371008.8


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def compare_points(items: DataFrame, addresses: DataFrame, geocoded: DataFrame, features: DataFrame, threshold: float = 50.0) -> DataFrame:
    """What geocoding proposes for each item beside the point it has.

    ``items(item_id)``, ``addresses(item_id, address)`` (P7), ``geocoded`` (J9),
    ``features(item_id, lat, lng)`` one point per item (J10). Output ``(item_id,
    address, lat, lng, label, current_lat, current_lng, has_feature, metres,
    status)``: ``no address``, ``no result``, ``new`` (no point yet), ``same``
    (at most ``threshold`` metres apart) or ``moved``. The points of ``new`` and
    ``moved`` are what J10 would save.
    """
    current = features.select("item_id", F.col("lat").alias("current_lat"), F.col("lng").alias("current_lng"), F.lit(True).alias("_has"))
    j = (
        items.select("item_id")
        .join(addresses.select("item_id", "address"), "item_id", "left")
        .join(geocoded.select("item_id", "lat", "lng", "label"), "item_id", "left")
        .join(current, "item_id", "left")
    )
    # without an address there is nothing to look up, whatever town rows would match
    asked = ~is_blank("address")
    j = j.select("item_id", "address", *[F.when(asked, F.col(c)).alias(c) for c in ("lat", "lng", "label")], "current_lat", "current_lng", F.coalesce("_has", F.lit(False)).alias("has_feature"))
    metres = distance(F.col("current_lat"), F.col("current_lng"), F.col("lat"), F.col("lng"))
    status = (
        F.when(is_blank("address"), "no address")
        .when(F.col("lat").isNull() | F.col("lng").isNull(), "no result")
        .when(~F.col("has_feature") | metres.isNull(), "new")
        .when(metres <= threshold, "same")
        .otherwise("moved")
    )
    return j.withColumns({"metres": metres, "status": status})


def resolve_coordinates(items: DataFrame, markers: DataFrame, statements: DataFrame, addresses: DataFrame,
                        geocoded: DataFrame) -> DataFrame:
    """One point per item: its first marker, else explicit lat/lon
    properties, else the geocoded address; items with only an address keep
    it with no point; items with neither are dropped.

    ``markers(marker_id, item_id, lat, lng)``, ``addresses(item_id,
    address)`` (P7), ``geocoded`` from J9.
    """
    m = markers.groupBy("item_id").agg(F.min_by(F.struct("lat", "lng"), "marker_id").alias("_m"))
    props = statements.where(F.col("property").isin(LAT_PROP, LNG_PROP)).groupBy("item_id").agg(
        F.min(F.when(F.col("property") == LAT_PROP, F.col("value"))).cast("double").alias("_plat"),
        F.min(F.when(F.col("property") == LNG_PROP, F.col("value"))).cast("double").alias("_plng"),
    )
    j = (
        items.select("item_id")
        .join(m, "item_id", "left")
        .join(props, "item_id", "left")
        .join(addresses.select("item_id", "address"), "item_id", "left")
        .join(geocoded.select("item_id", F.col("lat").alias("_glat"), F.col("lng").alias("_glng")), "item_id", "left")
    )
    has_prop = F.col("_plat").isNotNull() & F.col("_plng").isNotNull()
    source = (
        F.when(F.col("_m").isNotNull(), "marker")
        .when(has_prop, "property")
        .when(F.col("_glat").isNotNull(), "geocode")
        .when(~is_blank("address"), "address")
    )
    lat = F.when(F.col("_m").isNotNull(), F.col("_m.lat")).when(has_prop, F.col("_plat")).otherwise(F.col("_glat"))
    lng = F.when(F.col("_m").isNotNull(), F.col("_m.lng")).when(has_prop, F.col("_plng")).otherwise(F.col("_glng"))
    return j.select("item_id", lat.alias("lat"), lng.alias("lng"), source.alias("source"), "address").where(
        F.col("source").isNotNull()
    )
