"""Nested clip specs, and the assets that they need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.media import dimensions, falsy, pixels


def _sorted_rows(order: list[str], fields: list[str]) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))))
    return F.transform(listed, lambda x: x["v"])


def nested(parent: DataFrame, child: DataFrame, key: str, child_key: str, name: str, order: list[str], fields: list[str] | None = None) -> DataFrame:
    """``parent`` with an array ``name`` of its child rows, sorted by ``order``; empty if it has none."""
    fields = fields or [c for c in child.columns if c != child_key]
    arrays = child.groupBy(child_key).agg(_sorted_rows(order, fields).alias(name)).withColumnRenamed(child_key, "_key")
    kind = arrays.schema[name].dataType
    return parent.join(arrays, parent[key] == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def with_boxes(segments: DataFrame, boxes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Segments with their crop boxes, and those with their keyframes."""
    framed = nested(boxes, keyframes, "id", "box_id", "box_keyframes", ["t_ms", "kf_seq"])
    return nested(segments, framed, "id", "segment_id", "crop_boxes", ["slot_index", "id"])


def _lists(child: DataFrame, within: str, child_key: str, order: list[str]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``within`` and a map from ``child_key`` to its rows' array; and what looks a key up in it."""
    fields = [c for c in child.columns if c not in (within, child_key)]
    name = f"_of_{child_key}"
    arrays = child.where(F.col(child_key).isNotNull()).groupBy(within, child_key).agg(_sorted_rows(order, fields).alias("_rows"))
    none = F.array().cast(arrays.schema["_rows"].dataType)
    return arrays.groupBy(within).agg(F.map_from_entries(F.collect_list(F.struct(child_key, "_rows"))).alias(name)), lambda k: F.coalesce(F.col(name)[k], none)


def segments_within(clips: DataFrame, segments: DataFrame, boxes: DataFrame, keyframes: DataFrame, within: str = "clip_id") -> DataFrame:
    """``clips`` with ``segments``, as ``with_boxes`` nests them, where boxes and keyframes have their clip as well (it is not nested).

    Each table is grouped by its clip and nothing is joined but by it, so tables that lie dealt out by clip do not move.
    """
    b, boxes_of = _lists(boxes, within, "segment_id", ["slot_index", "id"])
    k, frames_of = _lists(keyframes, within, "box_id", ["t_ms", "kf_seq"])
    fields = [c for c in segments.columns if c != within]
    s = segments.groupBy(within).agg(_sorted_rows(["sort_order", "id"], fields).alias("segments"))
    box_fields = [c for c in boxes.columns if c not in (within, "segment_id")]
    box = lambda x: F.struct(*[x[c].alias(c) for c in box_fields], frames_of(x["id"]).alias("box_keyframes"))
    segment = lambda x: F.struct(*[x[c].alias(c) for c in fields], F.transform(boxes_of(x["id"]), box).alias("crop_boxes"))
    rows = s.join(b, within, "left").join(k, within, "left").select(within, F.transform("segments", segment).alias("segments"))
    none = F.array().cast(rows.schema["segments"].dataType)
    return clips.join(rows, within, "left").withColumn("segments", F.coalesce("segments", none))


def clip_specs(
    clips: DataFrame, segments: DataFrame, boxes: DataFrame, keyframes: DataFrame, children: dict[str, DataFrame], words: DataFrame | None = None, quality: Column | None = None, by_clip: bool = False
) -> DataFrame:
    """One nested row for each clip.

    ``children``: name → rows with clip_id (caption_styles, text_overlays, audio_tracks,
    transitions, overlays); overlays are sorted by z_index, all by id.  ``words``: clip_id and an
    array ``words`` (see ``transcript.spoken``).  ``quality`` sets output_width and output_height, 2160p
    unless given.  ``by_clip``: boxes and keyframes have clip_id as well, see ``segments_within``.
    """
    if by_clip:
        out = segments_within(clips, segments, boxes, keyframes)
    else:
        out = nested(clips, with_boxes(segments, boxes, keyframes), "clip_id", "clip_id", "segments", ["sort_order", "id"])
    for name, rows in children.items():
        out = nested(out, rows, "clip_id", "clip_id", name, ["z_index", "id"] if "z_index" in rows.columns else ["id"])
    if words is not None:
        kind = words.schema["words"].dataType
        out = out.join(words.select("clip_id", "words"), "clip_id", "left").withColumn("words", F.coalesce("words", F.array().cast(kind)))
    size = dimensions(F.lit("2160p") if quality is None else quality)
    return out.withColumn("output_width", size["w"]).withColumn("output_height", size["h"])


def as_json(specs: DataFrame, key: str = "clip_id") -> DataFrame:
    """``key, json``: each row as JSON, nulls written out."""
    return specs.select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def secondary_sources(boxes: DataFrame, videos: DataFrame, by: str = "clip_id") -> DataFrame:
    """``by, video_id, storage_path`` of the distinct other videos that boxes show, if they are stored."""
    used = boxes.where(F.col("source_video_id").isNotNull() & (F.col("source_video_id").cast("string") != "")).select(by, F.col("source_video_id").alias("video_id")).distinct()
    stored = videos.where(F.col("storage_path").isNotNull() & (F.col("storage_path") != "")).select("video_id", "storage_path")
    return used.join(stored, "video_id").select(by, "video_id", "storage_path")


def image_overlays(overlays: DataFrame) -> DataFrame:
    """Overlays of type image with a path."""
    return overlays.where((F.col("type") == "image") & F.col("storage_path").isNotNull() & (F.col("storage_path") != ""))


def shown_text(overlays: DataFrame) -> DataFrame:
    """Text overlays that have text; a single space is text."""
    return overlays.where(F.col("text").isNotNull() & (F.col("text") != ""))


def assets(clips: DataFrame, secondary: DataFrame, overlays: DataFrame, tracks: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``clip_id, kind, key, name`` of every object that a clip needs; with ``listing`` (key) only those that exist.

    ``name`` is a local name that differs for different keys.
    """
    rows = (
        clips.select("clip_id", F.lit("source").alias("kind"), F.col("storage_path").alias("key"))
        .unionByName(secondary.select("clip_id", F.lit("secondary").alias("kind"), F.col("storage_path").alias("key")))
        .unionByName(image_overlays(overlays).select("clip_id", F.lit("overlay").alias("kind"), F.col("storage_path").alias("key")))
        .unionByName(tracks.select("clip_id", F.lit("music").alias("kind"), F.col("storage_path").alias("key")))
        .where(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    )
    if listing is not None:
        rows = rows.join(listing.select("key").distinct(), "key", "left_semi")
    return rows.withColumn("name", F.sha2("key", 256))


def missing_assets(needed: DataFrame, listing: DataFrame) -> DataFrame:
    return needed.join(listing.select("key").distinct(), "key", "left_anti")


def text_geometry(overlays: DataFrame, width: int, height: int) -> DataFrame:
    """Text overlays with pixel places; zero, empty and null take the defaults."""
    rows = shown_text(overlays)
    return rows.withColumns({
        "px": pixels(falsy(F.col("x"), 0.1), width), "py": pixels(falsy(F.col("y"), 0.1), height),
        "font_size": falsy(F.col("size"), 48).cast("int"), "font": falsy(F.col("font"), "roboto"), "color": falsy(F.col("color"), "#ffffff"),
    })


def image_geometry(overlays: DataFrame, clips: DataFrame, width: int, height: int) -> DataFrame:
    """Image overlays with pixel rectangles and times; only null takes a default, sizes are at least 1."""
    length = clips.select("clip_id", (F.col("end_ms") - F.col("start_ms")).alias("_length"))
    return image_overlays(overlays).join(length, "clip_id").withColumns({
        "px": pixels(F.coalesce("x", F.lit(0.0)), width), "py": pixels(F.coalesce("y", F.lit(0.0)), height),
        "pw": pixels(F.coalesce("w", F.lit(0.2)), width, 1), "ph": pixels(F.coalesce("h", F.lit(0.2)), height, 1),
        "start_ms": F.coalesce("start_ms", F.lit(0).cast("bigint")), "end_ms": F.coalesce("end_ms", "_length"),
    }).drop("_length")
