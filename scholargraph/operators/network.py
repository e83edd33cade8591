"""Organisation collaboration network, bounds and GeoJSON."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.joins import bounded_broadcast
from scholargraph.session import cut_lineage

# Events with more organisations than this are split into salted slices.
SALT_CHUNK = 512
MAX_WEIGHT = 6


def event_orgs(members: DataFrame, contributors: DataFrame, events: DataFrame, located: DataFrame) -> DataFrame:
    """Distinct ``(event_id, org_id)``: organisations of an event's contributors.

    ``members(org_id, person_id)``, ``contributors(event_id, person_id)``,
    ``events(event_id)`` of the Event class, ``located(org_id)`` with a
    point. Made distinct before any pairing.
    """
    eo = contributors.select("event_id", "person_id").join(members.select("org_id", "person_id"), "person_id")
    eo = eo.join(events.select("event_id"), "event_id", "left_semi").join(located.select("org_id"), "org_id", "left_semi")
    return eo.select("event_id", "org_id").distinct()


def collaboration_edges(eo: DataFrame, chunk: int = SALT_CHUNK) -> tuple[DataFrame, DataFrame]:
    """A4: per pair of organisations sharing events, the number of events.

    Returns ``(edges, edge_events)``: ``edges(src, dst, n_events, weight,
    first_event, last_event)`` with ``src < dst`` and display weight
    ``min(1 + n, 6)``; ``edge_events(src, dst, event_id)`` the full event
    list of each edge in long form (nothing is gathered into one row).

    The pairs of one event are produced by a self-join on the event. An
    event with ``k`` organisations is cut into ``ceil(k / chunk)`` salted
    slices: each left row takes one slice, right rows are copied to every
    slice of their event, so a hot event's pairs spread over many tasks
    and every pair is still produced once.
    """
    eo = cut_lineage(eo.select("event_id", "org_id"), "event-orgs")  # read by sizes, left and right
    # only events with more than a chunk of organisations need their size
    sizes = eo.groupBy("event_id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > chunk)
    s = eo.join(bounded_broadcast(sizes), "event_id", "left").withColumn("_s", F.ceil(F.coalesce("_k", F.lit(1)) / chunk).cast("int"))
    left = s.select("event_id", F.col("org_id").alias("src"), F.pmod(F.xxhash64("org_id"), F.col("_s")).cast("int").alias("_salt"))
    right = s.select("event_id", F.col("org_id").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_salt"))
    pairs = left.join(right, ["event_id", "_salt"]).where(F.col("src") < F.col("dst")).select("src", "dst", "event_id")
    edges = pairs.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    ).withColumn("weight", F.least(F.col("n_events") + 1, F.lit(MAX_WEIGHT)))
    return edges, pairs


def bounds(points: DataFrame) -> DataFrame:
    """Bounding box and count of points; with one point, its centre."""
    return points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"),
    ).select(
        "*",
        F.when(F.col("n_points") == 1, F.col("min_lat")).alias("center_lat"),
        F.when(F.col("n_points") == 1, F.col("min_lng")).alias("center_lng"),
    )


def mark_network(orgs: DataFrame, text: str) -> DataFrame:
    """``(item_id, kept)``: whether an organisation's title, acronym or
    address contains ``text`` (case-insensitive). ``orgs(item_id, title,
    acronym, address)``; written once, as the edges and the counts read it."""
    t = F.lower(F.lit(text.strip()))
    hit = F.lit(False)
    for c in ("title", "acronym", "address"):
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
    return cut_lineage(orgs.select("item_id", hit.alias("kept")), "network-marks")


def filter_network(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """the edges with both ends kept."""
    kept = marked.where("kept").select("item_id")
    return edges.join(kept.withColumnRenamed("item_id", "src"), "src", "left_semi").join(
        kept.withColumnRenamed("item_id", "dst"), "dst", "left_semi"
    )


def edges_geojson(edges: DataFrame, edge_events: DataFrame, orgs: DataFrame, max_titles: int = 50) -> DataFrame:
    """One GeoJSON LineString feature per edge, ``[lng, lat]`` order, with
    the titles of both ends (``from``, ``to``), the display weight, the number
    of events and the titles of the first ``max_titles`` events (a display
    length: ``n_events`` is complete and ``edge_events`` has them all).

    ``edge_events(src, dst, event_id, title)``; ``orgs(item_id, title, lat,
    lng)``, joined in for both ends. ``to_json`` writes the feature, so any
    title is escaped. Output ``(src, dst, feature)``; write with ``write.text``.
    """
    a = orgs.select(F.col("item_id").alias("src"), F.col("title").alias("t1"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    b = orgs.select(F.col("item_id").alias("dst"), F.col("title").alias("t2"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    order = Window.partitionBy("src", "dst").orderBy("event_id")
    shown = edge_events.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max_titles)
    titles = shown.groupBy("src", "dst").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", "title"))), lambda x: F.coalesce(x["title"], F.lit(""))).alias("titles")
    )
    j = edges.join(a, "src").join(b, "dst").join(titles, ["src", "dst"], "left")
    point = lambda lng, lat: F.array(F.col(lng), F.col(lat))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.array(point("lng1", "lat1"), point("lng2", "lat2")).alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("t1").alias("from"), F.col("t2").alias("to"), F.col("weight"), F.col("n_events").alias("events"),
            F.coalesce("titles", F.array().cast("array<string>")).alias("titles"),
        ).alias("properties"),
    )
    return j.select("src", "dst", F.to_json(feature).alias("feature"))
