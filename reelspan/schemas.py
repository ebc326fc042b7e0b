"""Columns of the tables that the library reads and writes.  Times are BIGINT ms (``*_ms``) or DOUBLE s (``*_s``)."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "jobs": "id string, type string, payload string, status string, error string, created_at timestamp, updated_at timestamp",
    "videos": "id string, source_url string, user_id string, storage_path string, status string, download_progress int, duration_ms bigint",
    "transcripts": "id string, video_id string, language string, created_at timestamp",
    "transcript_words": "transcript_id string, word_idx bigint, word string, word_roman string, start_ms bigint, end_ms bigint, speaker_id string, confidence double",
    "clips": "id string, video_id string, start_ms bigint, end_ms bigint, status string, output_url string, output_storage_path string",
    "segments": "id string, clip_id string, sort_order int, layout string, start_ms bigint, end_ms bigint",
    "crop_boxes": "id string, segment_id string, slot_index int, source_video_id string, source_offset_ms bigint",
    "box_keyframes": "box_id string, kf_seq bigint, t_ms bigint, x double, y double, w double, h double",
    "caption_styles": "id string, clip_id string, font string, size int, color string, position string, position_y double, animation string, timing_offset_ms bigint",
    "text_overlays": "id string, clip_id string, text string, font string, size int, color string, x double, y double, start_ms bigint, end_ms bigint",
    "audio_tracks": "id string, clip_id string, storage_path string, start_ms bigint, volume double, duck_under_speech boolean",
    "overlays": "id string, clip_id string, type string, storage_path string, x double, y double, w double, h double, start_ms bigint, end_ms bigint, z_index int",
    "transitions": "id string, clip_id string, type string, duration_ms bigint",
    #: Recognizer answers: three parallel arrays, or an array of records.
    "phrase_response": "language_code string, transcript string, timestamps struct<words: array<string>, start_time_seconds: array<double>, end_time_seconds: array<double>>",
    "word_response": "language string, words array<struct<word: string, start: double, end: double>>",
    "job_payload": "video_id string, storage_path string, clip_id string, clip_start_ms bigint, clip_end_ms bigint, language_code string, is_retranscribe boolean, video_storage_path string, quality string, watermark boolean",
}

TABLES = tuple(_DDL)


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
