"""Times, colours, sizes, keys and progress as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output width and height by quality.
DIMENSIONS = {"480p": (480, 854), "720p": (720, 1280), "1080p": (1080, 1920), "2160p": (2160, 3840)}
# Names of the caption fonts.
FONTS = {"noto-sans-telugu": "Noto Sans Telugu", "noto-sans-devanagari": "Noto Sans Devanagari", "roboto": "Roboto", "montserrat-bold": "Montserrat Bold"}

LONGEST_S, BUDGET_KBIT, AUDIO_KBPS, LEAST_KBPS = 1800, 44 * 8 * 1024, 96, 80


def ass_color(color: Column, alpha: int = 0) -> Column:
    """``#RRGGBB`` or ``#RGB`` as ``&HAABBGGRR``."""
    bare = F.regexp_replace(color, "^#+", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda k: F.upper(F.substring(full, k, 2))
    return F.concat(F.lit(f"&H{alpha:02X}"), part(5), part(3), part(1))


def ass_time(ms: Column) -> Column:
    """``H:MM:SS.cc`` of non-negative milliseconds, truncated."""
    part = lambda unit, of: F.floor(ms / unit) % of
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), part(10, 100))


def dimensions(quality: Column) -> Column:
    """struct<w, h>; an unknown quality is 1080p."""
    size = lambda wh: F.struct(F.lit(wh[0]).alias("w"), F.lit(wh[1]).alias("h"))
    known = F.create_map(*[x for q, wh in DIMENSIONS.items() for x in (F.lit(q), size(wh))])
    return F.coalesce(F.try_element_at(known, quality), size(DIMENSIONS["1080p"]))


def font_name(font: Column) -> Column:
    """A caption font's name: no font is Telugu Noto Sans, an unknown one Roboto."""
    known = F.create_map(*[F.lit(x) for pair in FONTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, falsy(font, "noto-sans-telugu")), F.lit("Roboto"))


def falsy(value: Column, default) -> Column:
    """``default`` for null, zero and the empty string."""
    empty = "" if isinstance(default, str) else 0
    return F.when(value.isNull() | (value == empty), F.lit(default)).otherwise(value)


def seconds_to_ms(seconds: Column, offset_ms: Column | int = 0) -> Column:
    """Rounded half up (for times from 0 on), plus an offset."""
    return F.round(seconds * 1000).cast("bigint") + offset_ms


def probed_seconds(probe: Column) -> Column:
    """A probe's duration; null if it is no number."""
    return F.trim(probe).try_cast("double")


def encode_budget(probe: Column) -> Column:
    """struct<duration_s, video_kbps, maxrate_kbps, bufsize_kbps, trimmed>: one size budget, whatever the length.

    A duration that is missing, zero or no number counts as 60 s; all are capped at 1800 s.
    """
    seconds = probed_seconds(probe)
    source = F.when(seconds.isNull() | F.isnan(seconds) | (seconds == 0), F.lit(60.0)).otherwise(seconds)
    length = F.least(source, F.lit(float(LONGEST_S)))
    video = F.greatest(F.lit(LEAST_KBPS), F.floor(BUDGET_KBIT / length) - AUDIO_KBPS).cast("bigint")
    return F.struct(
        length.alias("duration_s"), video.alias("video_kbps"), F.floor(video * 1.5 + 0.5).cast("bigint").alias("maxrate_kbps"), (video * 3).alias("bufsize_kbps"), (source > LONGEST_S).alias("trimmed")
    )


def raw_key(user_id: Column, video_id: Column) -> Column:
    return F.concat(F.lit("raw/"), user_id, F.lit("/"), video_id, F.lit(".mp4"))


def clip_key(clip_id: Column) -> Column:
    return F.concat(F.lit("clips/"), clip_id, F.lit("/output.mp4"))


def audio_key(storage_path: Column) -> Column:
    """The path with its extension replaced; unchanged without one."""
    return F.regexp_replace(storage_path, r"\.[^.]+$", "_audio.flac")


def download_percent(line: Column) -> Column:
    """Percent of a downloader's log line; null for other lines."""
    return F.nullif(F.regexp_extract(line, r"\[download\]\s+([\d.]+)%", 1), F.lit("")).try_cast("double")


def encoded_seconds(line: Column) -> Column:
    """Seconds of an encoder's progress line (its value is in microseconds); null for other lines."""
    return F.nullif(F.regexp_extract(line, r"out_time_ms=(\d+)", 1), F.lit("")).try_cast("double") / 1_000_000


def download_progress(percent: Column) -> Column:
    return F.round(5 + percent * 0.4).cast("bigint")


def encode_progress(seconds: Column, duration_s: Column) -> Column:
    return F.round(47 + F.least(F.lit(1.0), seconds / duration_s) * 8).cast("bigint")


def recognition_progress(chunk: Column, chunks: Column) -> Column:
    return F.round(63 + chunk / chunks * 33).cast("bigint")


def pixels(fraction: Column, size: Column | int, least: int | None = None) -> Column:
    """A fraction of a size, truncated."""
    out = (fraction * size).cast("int")
    return out if least is None else F.greatest(F.lit(least), out)
