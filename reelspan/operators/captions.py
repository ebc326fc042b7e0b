"""Caption lines from timed words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from reelspan.functions.media import ass_color, ass_time, falsy, font_name, pixels
from reelspan.functions.text import display_word, ends_sentence
from reelspan.operators.ranges import points_in
from reelspan.operators.scans import before, carried, dealt

GAP_MS, LINE_WORDS, LINGER_MS = 300, 5, 200
AHEAD_MS, HOLD_MS = 500, 500
#: Words of a transcript are held for 4 s at most; longer ones only cost more copies.
LONGEST_MS = 10_000


def in_clips(words: DataFrame, clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """Words that touch their clip (both ends count), in clip time."""
    c = clips.select(key, F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    own = words.join(c, key).where((F.col("end_ms") >= F.col("_from")) & (F.col("start_ms") <= F.col("_to")))
    return own.withColumns({"start_ms": F.col("start_ms") - F.col("_from"), "end_ms": F.col("end_ms") - F.col("_from")}).drop("_from", "_to")


def lines(words: DataFrame, order: list[str], key: str = "clip_id", stretch: Column | None = None, n_words: int | None = None) -> DataFrame:
    """``words`` with ``line`` and ``place``: a line ends after a sentence end, before a gap over 300 ms, or with its 5th word.

    Hard breaks make islands; inside one every fifth word starts a line, since a line that fills up starts the count anew.
    With ``stretch``, a column that never falls in list order, a video is worked on in stretches of equal values (see ``scans``):
    the automaton's state between them is the place in the line, the last end, and whether a sentence ended.
    ``n_words``: about how many words there are, if known: see ``scans.dealt``.
    """
    return _numbered(words, order, key, stretch, n_words).drop("_stretch")


def _numbered(words: DataFrame, order: list[str], key: str, stretch: Column | None, n_words: int | None) -> DataFrame:
    """``lines``, with the column ``_stretch`` if there is one.  All windows are over one order, so that words are sorted once."""
    ends = ends_sentence(F.col("word"))
    by = [key] if stretch is None else [key, "_stretch"]
    out = dealt(words if stretch is None else words.withColumn("_stretch", stretch), by, n_words)
    own = Window.partitionBy(*by).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    hard = F.coalesce(F.lag(ends).over(own), F.lit(False)) | F.coalesce(F.col("start_ms") - F.lag("end_ms").over(own) > GAP_MS, F.lit(False))
    out = out.withColumns({"_ends": ends, "_hard": hard, "_at": F.row_number().over(own)}).withColumn("_broken", F.max(F.when(F.col("_hard"), F.col("_at"))).over(so_far))
    out = out.withColumn("_inside", F.col("_at") - F.coalesce("_broken", F.lit(1)))
    line = F.sum((F.col("_inside") % LINE_WORDS == 0).cast("int")).over(so_far) - 1
    if stretch is not None:
        # Lines that start after the first hard break; those before it hang on what comes before the stretch.
        out = out.withColumn("_later", F.sum((F.col("_broken").isNotNull() & (F.col("_inside") % LINE_WORDS == 0)).cast("int")).over(so_far))
        out = carried(out, key, _line_summary(order), _line_carry)
        out = out.withColumn("_inside", F.col("_inside") + F.when(F.col("_broken").isNull(), F.col("_phase")).otherwise(0))
        line = F.col("_lines") + _up(F.col("_phase") + F.least("_at", "_open_words")) - _up(F.col("_phase")) + F.col("_later") - 1
    place = (F.col("_inside") % LINE_WORDS).cast("int")
    return out.withColumn("line", line.cast("bigint")).withColumn("place", place).drop("_ends", "_hard", "_at", "_broken", "_inside", "_later", "_phase", "_lines", "_open_words")


def _up(x: Column) -> Column:
    """Lines that ``x`` words of an island begin."""
    return F.ceil(x / LINE_WORDS)


def _line_summary(order: list[str]) -> dict[str, Column]:
    """Of a stretch: its ends, its words, those before its first hard break and after its last one, and the lines that start between."""
    at = F.struct(*order)
    return {
        "first_start": F.min_by("start_ms", at), "last_end": F.max_by("end_ms", at), "last_ends": F.max_by("_ends", at), "n": F.count(F.lit(1)), "n_open": F.count_if(F.col("_broken").isNull()),
        "n_tail": F.max_by(F.col("_inside") + 1, at), "broken": F.max("_broken"), "later_lines": F.max("_later"),
    }


def _line_carry(line: WindowSpec) -> dict[str, Column]:
    """What a stretch starts with: the place in the line (``_phase``) and the lines before (``_lines``); and its words before the first hard break."""
    words_before = F.coalesce(F.sum("n").over(before(line)), F.lit(0))
    anew = F.coalesce(F.lag("last_ends").over(line), F.lit(False)) | F.coalesce(F.col("first_start") - F.lag("last_end").over(line) > GAP_MS, F.lit(False))
    since = F.when(F.col("broken").isNotNull(), F.col("__words") + F.col("n") - F.col("n_tail")).when(F.col("__anew"), F.col("__words"))
    return {
        "__words": words_before, "__anew": anew,
        # Where the island began that is open at the end of a stretch, counted in words of the video.
        "__since": since, "__open": F.when(F.col("__anew"), F.col("__words")).otherwise(F.coalesce(F.last("__since", ignorenulls=True).over(before(line)), F.lit(0))),
        "_phase": (F.col("__words") - F.col("__open")) % LINE_WORDS,
        "__started": _up(F.col("_phase") + F.col("n_open")) - _up(F.col("_phase")) + F.col("later_lines"),
        "_lines": F.coalesce(F.sum("__started").over(before(line)), F.lit(0)), "_open_words": F.col("n_open"),
    }


def events(words: DataFrame, order: list[str], key: str = "clip_id", roman: str | None = None, stretch: Column | None = None, n_words: int | None = None) -> DataFrame:
    """``key, line, start_ms, end_ms, text`` of the lines that have text.

    From the first word's start (0 at least) to 200 ms after the last word's end.  ``stretch``, ``n_words``: see ``lines``.
    A line's words follow one another, so its first word looks ahead for the others: no list of words is grouped.  With
    ``stretch``, what a line has in each stretch is a row, and those are put together.
    """
    shown = display_word(F.col("word"), F.col(roman) if roman else F.lit(None).cast("string"))
    own = Window.partitionBy(*([key] if stretch is None else [key, "_stretch"])).orderBy(*order)
    rows = _numbered(words, order, key, stretch, n_words).select(key, *([] if stretch is None else ["_stretch"]), *order, "line", "place", "start_ms", "end_ms", shown.alias("_shown"))
    word = F.struct("line", "end_ms", "_shown")
    ahead = {f"_{k}": F.lead(word, k).over(own) for k in range(1, LINE_WORDS)}
    heads = rows.withColumns(ahead | {"_previous": F.lag("line").over(own)}).where(F.col("_previous").isNull() | (F.col("_previous") != F.col("line")))
    same = [F.col(f"_{k}.line") == F.col("line") for k in range(1, LINE_WORDS)]
    last_end = reduce(lambda below, k: F.when(same[k - 1], F.col(f"_{k}.end_ms")).otherwise(below), range(1, LINE_WORDS), F.col("end_ms"))
    listed = F.filter(F.array("_shown", *[F.when(same[k - 1], F.col(f"_{k}._shown")) for k in range(1, LINE_WORDS)]), lambda x: x != "")
    found = heads.select(key, "line", "place", "start_ms", last_end.alias("end_ms"), listed.alias("_listed"))
    text = F.array_join("_listed", " ")
    if stretch is not None:
        parts = F.array_sort(F.collect_list(F.struct("place", "_listed")))
        text = F.array_join(F.flatten(F.transform("_parts", lambda x: x["_listed"])), " ")
        found = dealt(found, [key, "line"], n_words and n_words // 3).groupBy(key, "line").agg(F.min_by("start_ms", "place").alias("start_ms"), F.max_by("end_ms", "place").alias("end_ms"), parts.alias("_parts"))
    found = found.select(key, "line", F.greatest(F.lit(0), "start_ms").cast("bigint").alias("start_ms"), (F.col("end_ms") + LINGER_MS).alias("end_ms"), text.alias("text"))
    return found.where(F.btrim("text") != "")


def karaoke_lines(words: DataFrame, times: DataFrame, order: list[str], key: str = "clip_id", longest_ms: int | None = LONGEST_MS) -> DataFrame:
    """``times`` (key, t_ms and others) with ``sentence``: the one sung at t, or that of the next word in list order within 500 ms, else null.

    Sentences end at punctuation only.  ``longest_ms``: about how long the longest words are.
    """
    own = Window.partitionBy(key).orderBy(*order)
    starts = F.coalesce(F.lag(ends_sentence(F.col("word"), trim=False)).over(own), F.lit(False)).cast("int")
    w = words.withColumn("_start", starts).select(
        key, (F.row_number().over(own) - 1).alias("seq"), F.sum("_start").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("sentence"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to")
    )
    t = times.dropDuplicates([key, "t_ms"]).select(key, "t_ms")
    sung = points_in(t, w, key, F.col("t_ms"), F.col("_from"), F.col("_to"), longest_ms=longest_ms).groupBy(key, "t_ms").agg(F.min_by("sentence", "seq").alias("_sung"))
    # The first word in list order that starts after t: of words that start later than all before them, the earliest such.
    record = w.withColumn("_before", F.max("_from").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_before").isNull() | (F.col("_from") > F.col("_before")))
    soonest = F.greatest("_before", F.col("_from") - AHEAD_MS + 1)
    ahead = points_in(t, record, key, F.col("t_ms"), soonest, F.col("_from"), longest_ms=AHEAD_MS).select(key, "t_ms", F.col("sentence").alias("_ahead"))
    return times.join(sung, [key, "t_ms"], "left").join(ahead, [key, "t_ms"], "left").withColumn("sentence", F.coalesce("_sung", "_ahead")).drop("_sung", "_ahead")


def visible_words(words: DataFrame, times: DataFrame, key: str = "clip_id", longest_ms: int | None = LONGEST_MS) -> DataFrame:
    """Words on screen at each time without karaoke: from their start until 500 ms after their end (that excluded)."""
    return points_in(times, words, key, F.col("t_ms"), F.col("start_ms"), F.col("end_ms") + HOLD_MS, longest_ms=longest_ms)


def first_style(styles: DataFrame, key: str = "clip_id", by: str = "id") -> DataFrame:
    """One style for each clip: that with the smallest id."""
    return styles.groupBy(key).agg(F.min_by(F.struct("*"), by).alias("s")).select("s.*")


def script_header(width: Column, height: Column, font: Column, size: Column, color: Column) -> Column:
    """The lines of a caption script before its dialogue, as an array."""
    # The script format's sections and field names.
    fixed = ["[Script Info]", "ScriptType: v4.00+"], ["WrapStyle: 0", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]"], ["", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]
    style_fields = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
    style = F.concat(F.lit("Style: Default,"), font_name(font), F.lit(","), falsy(size, 52).cast("string"), F.lit(","), ass_color(falsy(color, "#ffffff")), F.lit(",&H00FFFFFF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,3,2,5,10,10,10,1"))
    lit = lambda xs: [F.lit(x) for x in xs]
    return F.array(
        *lit(fixed[0]), F.concat(F.lit("PlayResX: "), width.cast("string")), F.concat(F.lit("PlayResY: "), height.cast("string")),
        *lit(fixed[1]), F.lit("Format: " + style_fields), style, *lit(fixed[2]),
    )


def scripts(caption_events: DataFrame, styles: DataFrame, width: int, height: int, key: str = "clip_id") -> DataFrame:
    """``key, n, line``: the caption script of each clip that has a style and a caption, a row for each line.

    Rows, not one text: a long clip's script is never one value.  The lines before the dialogue come with a clip's first caption,
    so captions are read once.
    """
    s = first_style(styles, key).select(key, "position_y", "font", "size", "color")
    x, y = F.lit(width // 2), pixels(falsy(F.col("position_y"), 0.84), height)
    tag = F.concat(F.lit("{\\pos("), x.cast("string"), F.lit(","), y.cast("string"), F.lit(")}"))
    said = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), tag, F.col("text"))
    own = F.array(F.struct((F.col("line") + 1000).alias("n"), said.alias("line")))
    header = script_header(F.lit(width), F.lit(height), F.col("font"), F.col("size"), F.col("color"))
    head = F.transform(header, lambda line, n: F.struct(n.cast("bigint").alias("n"), line.alias("line")))
    first = F.row_number().over(Window.partitionBy(key).orderBy("line")) == 1
    spoken = caption_events.withColumn("_first", first).join(s, key)
    return spoken.select(key, F.inline(F.when(F.col("_first"), F.concat(head, own)).otherwise(own)))
