"""From recognizer answers to a video's transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.languages import resolve_script, roman_word, script_rank
from reelspan.functions.media import seconds_to_ms
from reelspan.operators.alignment import align
from reelspan.operators.ranges import touching
from reelspan.operators.scans import carried

CHUNK_S, LONGEST_HOLD_S = 25, 4.0
UNKNOWN = "unknown"


def chunk_plan(totals: DataFrame, key: str = "video_id") -> DataFrame:
    """Recognizer chunks of 25 s: ``key, chunk_idx, start_s, length_s``; none for a total of zero or less."""
    n = F.ceil(F.col("total_s") / CHUNK_S).cast("int")
    chunk = F.explode(F.sequence(F.lit(0), n - 1))
    out = totals.where(F.col("total_s") > 0).select(key, chunk.alias("chunk_idx"))
    return out.select(key, "chunk_idx", (F.col("chunk_idx") * CHUNK_S).cast("double").alias("start_s"), F.lit(float(CHUNK_S)).alias("length_s"))


def phrase_rows(answers: DataFrame) -> DataFrame:
    """Rows of the parallel-array form (column ``response``); a missing time is 0."""
    t = "response.timestamps"
    rows = answers.select("clip_id", "chunk_idx", F.col(t).alias("t"), F.posexplode(f"{t}.words").alias("phrase_idx", "phrase"))
    at = lambda c: F.coalesce(F.get(F.col(f"t.{c}"), F.col("phrase_idx")), F.lit(0.0))
    return rows.select("clip_id", "chunk_idx", "phrase_idx", "phrase", at("start_time_seconds").alias("start_s"), at("end_time_seconds").alias("end_s"))


def anchor_rows(answers: DataFrame) -> DataFrame:
    """Rows of the record form (column ``response``): trimmed words, empty ones dropped, places counted before."""
    rows = answers.select("clip_id", "chunk_idx", F.posexplode("response.words").alias("anchor_idx", "w"))
    word = F.btrim("w.word")
    return rows.where(word != "").select("clip_id", "chunk_idx", "anchor_idx", word.alias("word"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"))


def answer_language(answered: Column, requested: Column) -> Column:
    return F.coalesce(answered, requested, F.lit(UNKNOWN))


def _known(lang: Column) -> Column:
    return F.when(~lang.isin("", UNKNOWN), lang)


def transcript_language(chunks: DataFrame, key: str = "clip_id") -> DataFrame:
    """``key, language``: of the last chunk whose language is known, else 'unknown'."""
    return chunks.groupBy(key).agg(F.coalesce(F.max_by(_known(F.col("lang")), F.when(_known(F.col("lang")).isNotNull(), F.col("chunk_idx"))), F.lit(UNKNOWN)).alias("language"))


def request_language(chunks: DataFrame, key: str = "clip_id") -> DataFrame:
    """``key, chunk_idx, request_lang``: the given language, else what chunk 0 was heard as, from chunk 1 on.

    ``given`` is the language asked for (or null), ``lang`` what each chunk was heard
    as.  A clip of one chunk, and chunk 0 without a given language, are asked 'unknown'.
    """
    first = F.first_value(_known(F.col("lang"))).over(Window.partitionBy(key).orderBy("chunk_idx"))
    lang = F.coalesce(_known(F.col("given")), F.when(F.col("chunk_idx") > 0, first), F.lit(UNKNOWN))
    return chunks.select(key, "chunk_idx", lang.alias("request_lang"))


def to_video_time(words: DataFrame) -> DataFrame:
    """Chunk-relative to video seconds."""
    shift = F.col("chunk_idx") * CHUNK_S
    return words.withColumn("start_s", F.col("start_s") + shift).withColumn("end_s", F.col("end_s") + shift)


def clamp_ends(words: DataFrame, order: list[str], key: str = "clip_id", stretch: Column | None = None) -> DataFrame:
    """Each word ends where the next begins, at most 4 s after its own start; the last one at ``total_s`` if it ends before.

    Next is next in list order, not in time.  With ``stretch``, a column that never falls in list order, a video is worked
    on in stretches of equal values (see ``scans``), the last word of one ending where the next one begins.
    """
    after = F.lead("start_s").over(Window.partitionBy(*([key] if stretch is None else [key, "_stretch"])).orderBy(*order))
    if stretch is not None:
        words = words.withColumn("_stretch", stretch)
        words = carried(words, key, {"first": F.min_by("start_s", F.struct(*order))}, lambda line: {"_then": F.lead("first").over(line)})
        after = F.coalesce(after, "_then")
    last = F.when(F.col("end_s") < F.col("total_s"), F.col("total_s")).otherwise(F.col("end_s"))
    return words.withColumn("_after", after).withColumn("end_s", F.when(F.col("_after").isNull(), last).otherwise(F.least("_after", F.col("start_s") + LONGEST_HOLD_S))).drop("_after", "_then", "_stretch")


def word_stats(rows: DataFrame, *by: str, order: str = "anchor_idx") -> DataFrame:
    """Words, end of the last one and the first three of each answer."""
    listed = F.array_sort(F.collect_list(F.when(F.col(order) < 3, F.struct(order, "word"))))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_words"), F.max_by("end_s", order).alias("last_end_s"), F.array_join(F.transform(listed, lambda x: x["word"]), " ").alias("sample"))


def batches(words: DataFrame, size: int, order: str = "pos", key: str = "clip_id") -> DataFrame:
    """``key, batch, words``: arrays of ``size`` consecutive words (``order`` counts from 0)."""
    batch = F.floor(F.col(order) / size).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct(order, "word")))
    return words.groupBy(key, batch.alias("batch")).agg(F.transform(listed, lambda x: x["word"]).alias("words"))


def zip_back(batch_words: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a batch with the answer's items of the same place; a short side gives null."""
    both = batch_words.join(answers, keys, "left").select(*keys, F.posexplode(F.arrays_zip("words", F.coalesce("items", F.array().cast("array<string>")).alias("items"))).alias("pos", "z"))
    return both.where(F.col("pos") >= 0).select(*keys, "pos", F.col("z.words").alias("word"), F.col("z.items").alias("item"))


def build(phrases: DataFrame, anchors: DataFrame, totals: DataFrame, languages: DataFrame, offset_ms: Column | int = 0) -> DataFrame:
    """The transcript: ``clip_id, word_idx, word, word_roman, start_ms, end_ms, language``.

    ``totals``: clip_id, total_s.  ``languages``: clip_id, chunk_idx, lang.
    """
    order = ["chunk_idx", "phrase_idx", "word_idx"]
    words = to_video_time(align(phrases, anchors)).join(totals, "clip_id", "left").join(transcript_language(languages), "clip_id", "left")
    own = Window.partitionBy("clip_id")
    # The script of the whole text is the first in preference that any word has: no text is put together for it.
    script = F.min(script_rank(F.col("word"))).over(own)
    place = F.row_number().over(own.orderBy(*order)) - 1
    return clamp_ends(words, order).select(
        "clip_id", place.cast("bigint").alias("word_idx"), "word", resolve_script(F.col("language"), script).alias("_locale"),
        seconds_to_ms(F.col("start_s"), offset_ms).alias("start_ms"), seconds_to_ms(F.col("end_s"), offset_ms).alias("end_ms"), "language",
    ).select("clip_id", "word_idx", "word", roman_word(F.col("word"), F.col("_locale")).alias("word_roman"), "start_ms", "end_ms", "language")


def latest(transcripts: DataFrame, key: str = "video_id") -> DataFrame:
    """The newest transcript of each video, ties by the larger id."""
    own = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return transcripts.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def clip_words(clips: DataFrame, transcripts: DataFrame, words: DataFrame) -> DataFrame:
    """Words of the newest transcript of each clip's video that touch the clip (both ends count), in clip time.

    ``clips``: clip_id, video_id, start_ms, end_ms; ``words``: transcript_id, start_ms, end_ms and others.
    A word meets only the clips of its minutes, however many clips its video has.
    """
    newest = latest(transcripts).select("video_id", F.col("id").alias("transcript_id"))
    c = clips.select("clip_id", "video_id", F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to")).join(newest, "video_id").drop("video_id")
    own = touching(words, c, "transcript_id", F.col("start_ms"), F.col("end_ms"), F.col("_from"), F.col("_to"))
    return own.withColumns({"start_ms": F.col("start_ms") - F.col("_from"), "end_ms": F.col("end_ms") - F.col("_from")}).drop("_from", "_to")


def minutes(words: DataFrame, order: list[str], fields: list[str], width_ms: int = 60_000) -> DataFrame:
    """``transcript_id, from_ms, to_ms, said``: the words of each minute as one array in the order of start and ``order``, and the time that they cover."""
    end = F.greatest("start_ms", "end_ms")
    listed = F.array_sort(F.collect_list(F.struct(F.struct("start_ms", *order).alias("o"), F.col("end_ms").alias("e"), F.struct(*fields).alias("v"))))
    return words.groupBy("transcript_id", F.floor(F.col("start_ms") / width_ms).alias("_minute")).agg(F.min("start_ms").alias("from_ms"), F.max(end).alias("to_ms"), listed.alias("said")).drop("_minute")


def spoken(clips: DataFrame, transcripts: DataFrame, words: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """``clip_id, words``: what is said in each clip (words that touch it, both ends counting) by its video's newest transcript, as one array of ``fields``.

    In the order of start and ``order``, in video time.  Words travel as arrays of a minute; a clip takes the minutes that it
    touches and cuts what it needs out of them, so a long video with many clips sends each clip its own part only.  Clips
    without such words, or without a transcript, have no row.
    """
    newest = latest(transcripts).select("video_id", F.col("id").alias("transcript_id"))
    c = clips.select("clip_id", "video_id", F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to")).join(newest, "video_id").drop("video_id")
    # Words of other transcripts do not travel.
    used = words.join(c.select("transcript_id").distinct(), "transcript_id", "left_semi")
    met = touching(minutes(used, order, fields), c, "transcript_id", F.col("from_ms"), F.col("to_ms"), F.col("_from"), F.col("_to"))
    own = F.filter("said", lambda w: (w["e"] >= F.col("_from")) & (w["o"]["start_ms"] <= F.col("_to")))
    cut = met.select("clip_id", "from_ms", F.transform(own, lambda w: w["v"]).alias("said")).where(F.size("said") > 0)
    # Minutes are in order inside, and no two of a transcript start at one time.
    listed = F.array_sort(F.collect_list(F.struct("from_ms", "said")))
    return cut.groupBy("clip_id").agg(F.flatten(F.transform(listed, lambda m: m["said"])).alias("words"))


def replaced(old: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key it does not have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
