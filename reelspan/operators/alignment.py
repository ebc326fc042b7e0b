"""Aligning phrase words with timing anchors.

One equi-join on (clip, chunk) brings each phrase its overlapping anchors, as an
array of bounded length; everything after it keeps that partitioning, so nothing
is shuffled again.  Candidate pairs of word and anchor become rows, so that their
similarity runs in generated code, once a pair; the only sequential part, that matches
never go backwards, is a fold over a phrase's few candidates that are alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import normalize_word, similar_normal, tokens

CHUNK = ["clip_id", "chunk_idx"]
PHRASE = [*CHUNK, "phrase_idx"]


def phrase_anchors(phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """Phrases with ``words`` (array of tokens) and ``anchors`` (array, in list order, of those that overlap them).

    Overlap is strict at both ends; an anchor may serve several phrases.  A phrase
    without anchors has an empty array.
    """
    # Normal forms are made before an anchor is copied to the phrases that it overlaps.
    a = anchors.select(*CHUNK, F.struct("anchor_idx", "word", "start_s", "end_s", normalize_word(F.col("word")).alias("normal")).alias("a"))
    meets = [phrases[c] == a[c] for c in CHUNK] + [(F.col("a.start_s") < phrases["end_s"]) & (F.col("a.end_s") > phrases["start_s"])]
    found = phrases.join(a, meets, "left").select(*[phrases[c] for c in phrases.columns], "a")
    listed = F.array_sort(F.collect_list("a")).alias("anchors")  # nulls are left out
    own = found.groupBy(*PHRASE).agg(F.first("phrase").alias("phrase"), F.first("start_s").alias("start_s"), F.first("end_s").alias("end_s"), listed)
    return own.withColumn("words", tokens(F.col("phrase")))


def overlapping(phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row for each phrase and anchor that overlap: ``j`` its place among the phrase's ``n``."""
    rows = phrase_anchors(phrases, anchors).select(*PHRASE, F.size("anchors").alias("n"), F.posexplode("anchors").alias("j", "a"))
    return rows.select(*PHRASE, "a.anchor_idx", F.col("a.word").alias("anchor"), F.col("a.start_s").alias("anchor_start"), F.col("a.end_s").alias("anchor_end"), "j", "n")


def phrase_tokens(phrases: DataFrame) -> DataFrame:
    """One row per word of a phrase: ``i`` its place, ``m`` the number of words."""
    own = phrases.withColumn("_tokens", tokens(F.col("phrase")))
    return own.select(*PHRASE, "start_s", "end_s", F.size("_tokens").alias("m"), F.posexplode("_tokens").alias("i", "word"))


def even_split(phrase_words: DataFrame) -> DataFrame:
    """A phrase's time shared evenly among its words."""
    length = F.col("end_s") - F.col("start_s")
    return phrase_words.select(
        *PHRASE, F.col("i").alias("word_idx"), "word",
        (F.col("start_s") + F.col("i") / F.col("m") * length).alias("start_s"),
        (F.col("start_s") + (F.col("i") + 1) / F.col("m") * length).alias("end_s"),
    )


#: Candidates in the order of word, distance and place; each word takes its first one after the last match.
_FOLD = """
aggregate(near, named_struct('least', 0, 'word', -1, 'out', cast(array() AS array<struct<i: int, j: int>>)),
  (s, x) -> if(x.i > s.word AND x.j >= s.least, named_struct('least', x.j + 1, 'word', x.i, 'out', array_append(s.out, named_struct('i', x.i, 'j', x.j))), s),
  s -> s.out)"""


def candidates(spoken: DataFrame) -> DataFrame:
    """``clip_id, chunk_idx, phrase_idx, near``: of each phrase of ``phrase_anchors``, the pairs ``(i, d, j)`` of a word and a similar anchor near its place.

    Word i looks within max(3, n/4) places of its proportional place; ``d`` is how far j is from that.
    """
    n, m = F.size("anchors"), F.size("words")
    words = spoken.select(*PHRASE, m.alias("m"), n.alias("n"), F.transform("anchors", lambda a: a["normal"]).alias("others"), F.posexplode("words").alias("i", "word")).where("n > 0")
    expected = F.round(F.col("i") * (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1))).cast("int")
    window = F.greatest(F.lit(3), F.round(F.col("n") / 4)).cast("int")
    placed = words.select(*PHRASE, "i", normalize_word(F.col("word")).alias("a"), "others", expected.alias("at"), F.greatest(F.lit(0), expected - window).alias("low"), F.least(F.col("n") - 1, expected + window).alias("high"))
    # The slice is counted from ``low``, so nothing but the window's own anchors is copied.
    pairs = placed.select(*PHRASE, "i", "a", "at", "low", F.posexplode(F.slice("others", F.col("low") + 1, F.col("high") - F.col("low") + 1)).alias("k", "b")).withColumn("j", F.col("low") + F.col("k"))
    near = pairs.where(similar_normal(F.col("a"), F.col("b"))).select(*PHRASE, F.struct("i", F.abs(F.col("j") - F.col("at")).alias("d"), "j").alias("pair"))
    return near.groupBy(*PHRASE).agg(F.array_sort(F.collect_list("pair")).alias("near"))


def matched(spoken: DataFrame) -> DataFrame:
    """``clip_id, chunk_idx, phrase_idx, taken``: pairs ``(i, j)`` of a word and the anchor that it takes; phrases without a match may have no row.

    Of similar anchors after the last match, a word takes the nearest, the lower one of two.
    """
    return candidates(spoken).select(*PHRASE, F.expr(_FOLD).alias("taken"))


def matches(phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """``clip_id, chunk_idx, phrase_idx, i, j``: the anchor that each matched word takes."""
    return matched(phrase_anchors(phrases, anchors)).select(*PHRASE, F.explode("taken").alias("t")).select(*PHRASE, "t.i", "t.j")


def fill_gaps(aligned: DataFrame) -> DataFrame:
    """Times of unmatched words: the gap between the matched ones around them, shared evenly.

    Needs ``i, m, word, anchor_start, anchor_end`` (null if unmatched) and
    ``first_start, last_end`` of the phrase's anchors; without these, the even share
    of ``start_s, end_s``.
    """
    own = Window.partitionBy(*PHRASE).orderBy("i")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    matched = F.when(F.col("anchor_start").isNotNull(), F.col("i"))
    out = aligned.withColumns({
        "_lo": F.coalesce(F.last(matched, ignorenulls=True).over(before), F.lit(-1)), "_hi": F.coalesce(F.first(matched, ignorenulls=True).over(after), "m"),
        "_t0": F.coalesce(F.last("anchor_end", ignorenulls=True).over(before), "first_start", "start_s"), "_t1": F.coalesce(F.first("anchor_start", ignorenulls=True).over(after), "last_end", "end_s"),
    })
    size = F.greatest(F.col("_hi") - F.col("_lo") - 1, F.lit(1))
    # An even share may run backwards, a gap between anchors may not.
    width = F.when(F.col("first_start").isNull(), F.col("_t1") - F.col("_t0")).otherwise(F.greatest(F.lit(0.0), F.col("_t1") - F.col("_t0")))
    place = F.col("i") - F.col("_lo") - 1
    return out.select(
        *PHRASE, F.col("i").alias("word_idx"), "word",
        F.coalesce("anchor_start", F.col("_t0") + place / size * width).alias("start_s"),
        F.coalesce("anchor_end", F.col("_t0") + (place + 1) / size * width).alias("end_s"),
        F.col("anchor_start").isNotNull().alias("anchored"),
    )


def align(phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every word of every phrase with chunk-relative times: its anchor's, filled from its neighbours', or an even share.

    ``clip_id, chunk_idx, phrase_idx, word_idx, word, start_s, end_s, anchored``.
    """
    spoken = phrase_anchors(phrases, anchors)
    both = spoken.join(matched(spoken), PHRASE, "left").withColumn("hits", F.map_from_entries(F.transform("taken", lambda t: F.struct(t["i"], F.get("anchors", t["j"])))))
    rows = both.select(
        *PHRASE, "start_s", "end_s", F.size("words").alias("m"), F.get("anchors", F.lit(0))["start_s"].alias("first_start"),
        F.try_element_at("anchors", F.lit(-1))["end_s"].alias("last_end"), F.col("hits"), F.posexplode("words").alias("i", "word"),
    ).withColumn("hit", F.try_element_at("hits", F.col("i")))
    return fill_gaps(rows.select("*", F.col("hit.start_s").alias("anchor_start"), F.col("hit.end_s").alias("anchor_end")).drop("hit", "hits"))


def quality(aligned: DataFrame, *by: str) -> DataFrame:
    """Anchored and filled words per group."""
    return aligned.groupBy(*by).agg(F.count_if("anchored").alias("anchored_words"), F.count_if(~F.col("anchored")).alias("filled_words"))
