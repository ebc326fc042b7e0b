"""DuckDB SQL for each timeline query, written from the rules rather than from the Spark code."""

from __future__ import annotations

from reelspan.functions.languages import CODAS, CONSONANTS, LOCALES, SCRIPTS, SHORT_CODES, SIGNS, VOWELS
from reelspan.plans.fixtures import duck
from reelspan.plans.queries import CODES, LETTERS, TO_TELUGU

_ENDS = r"regexp_matches(word, '[.!?।]\s*$')"

_RANGES = """
r0 AS (SELECT clip_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words),
r1 AS (SELECT *, sum(CASE WHEN start_ms - reach >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r0),
ranges AS (SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r1 GROUP BY clip_id, island)"""


def _lines(src: str) -> str:
    """Caption lines of ``src`` (clip_id, turn, i, word, start_ms, end_ms)."""
    return f"""
l0 AS (SELECT *, coalesce(lag({_ENDS}) OVER w, false) OR coalesce(start_ms - lag(end_ms) OVER w > 300, false) AS hard FROM {src} WINDOW w AS (PARTITION BY clip_id ORDER BY turn, i)),
l1 AS (SELECT *, sum(cast(hard AS INT)) OVER (PARTITION BY clip_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY clip_id, island ORDER BY turn, i) - 1 AS inside FROM l1),
l3 AS (SELECT *, cast(sum(CASE WHEN inside % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS line FROM l2),
ev AS (SELECT clip_id, line, greatest(0, arg_min(start_ms, inside)) AS start_ms, arg_max(end_ms, inside) + 200 AS end_ms, string_agg(word, ' ' ORDER BY inside) AS text FROM l3 GROUP BY clip_id, line)"""


def _time(ms: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, ({ms} // 10) % 100)"


# Injective letters for a distance that counts bytes; the words are in lower case, so capitals are free.
_LOW = "ßàáâäåæçèéêëíîïñóôöùúûüÿœ"
_MAPPED = "ABCDEFGHIJKLMNOPQRSTUVWXY"


def _normal(w: str) -> str:
    return rf"regexp_replace(lower({w}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _alike(a: str, b: str) -> str:
    na, nb = (f"translate({_normal(x)}, '{_LOW}', '{_MAPPED}')" for x in (a, b))
    return f"({na} = {nb} OR (greatest(length({na}), length({nb})) > 2 AND cast(levenshtein({na}, {nb}) AS DOUBLE) / greatest(length({na}), length({nb})) < 0.45))"


_TOKENS = """
tk AS (SELECT clip_id, chunk_idx, phrase_idx, start_s, end_s, len(ws) AS m, unnest(range(len(ws))) AS i, unnest(ws) AS word
       FROM (SELECT *, list_filter(string_split(phrase, ' '), lambda x: x <> '') AS ws FROM asr_phrases))"""
_OVERLAPS = """
ov AS (SELECT p.clip_id, p.chunk_idx, p.phrase_idx, a.anchor_idx, a.word AS anchor, a.start_s AS a_start, a.end_s AS a_end,
              row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY p.clip_id, p.chunk_idx, p.phrase_idx) AS n
       FROM asr_phrases p JOIN asr_anchors a ON p.clip_id = a.clip_id AND p.chunk_idx = a.chunk_idx AND a.start_s < p.end_s AND a.end_s > p.start_s
       WINDOW w AS (PARTITION BY p.clip_id, p.chunk_idx, p.phrase_idx ORDER BY a.anchor_idx))"""
_MATCHES = f"""{_TOKENS}, {_OVERLAPS},
cand AS (SELECT *, abs(j - ex) AS d FROM (
           SELECT t.clip_id, t.chunk_idx, t.phrase_idx, t.i, t.m, t.word, o.j, o.anchor, cast(floor(cast(t.i * (o.n - 1) AS DOUBLE) / greatest(t.m - 1, 1) + 0.5) AS BIGINT) AS ex,
                  greatest(3, cast(floor(cast(o.n AS DOUBLE) / 4 + 0.5) AS BIGINT)) AS win
           FROM tk t JOIN ov o USING (clip_id, chunk_idx, phrase_idx))
         WHERE abs(j - ex) <= win AND {_alike("word", "anchor")}),
lists AS (SELECT clip_id, chunk_idx, phrase_idx, i, list(j ORDER BY d, j) AS js FROM cand GROUP BY ALL),
seqs AS (SELECT *, row_number() OVER (PARTITION BY clip_id, chunk_idx, phrase_idx ORDER BY i) AS k FROM lists),
walk AS (
  SELECT clip_id, chunk_idx, phrase_idx, i, k, js[1] AS j, coalesce(js[1] + 1, 0) AS least FROM seqs WHERE k = 1
  UNION ALL
  SELECT s.clip_id, s.chunk_idx, s.phrase_idx, s.i, s.k, list_filter(s.js, lambda x: x >= w.least)[1], coalesce(list_filter(s.js, lambda x: x >= w.least)[1] + 1, w.least)
  FROM walk w JOIN seqs s ON s.clip_id = w.clip_id AND s.chunk_idx = w.chunk_idx AND s.phrase_idx = w.phrase_idx AND s.k = w.k + 1),
hit AS (SELECT clip_id, chunk_idx, phrase_idx, i, j FROM walk WHERE j IS NOT NULL)"""
_ALIGNED = f"""{_MATCHES},
ends AS (SELECT clip_id, chunk_idx, phrase_idx, arg_min(a_start, j) AS b0, arg_max(a_end, j) AS bn FROM ov GROUP BY ALL),
al0 AS (SELECT t.*, e.b0, e.bn, o.a_start, o.a_end FROM tk t LEFT JOIN ends e USING (clip_id, chunk_idx, phrase_idx) LEFT JOIN hit h USING (clip_id, chunk_idx, phrase_idx, i)
        LEFT JOIN ov o ON o.clip_id = t.clip_id AND o.chunk_idx = t.chunk_idx AND o.phrase_idx = t.phrase_idx AND o.j = h.j),
al1 AS (SELECT *, last_value(CASE WHEN a_start IS NOT NULL THEN i END IGNORE NULLS) OVER bef AS lo, first_value(CASE WHEN a_start IS NOT NULL THEN i END IGNORE NULLS) OVER aft AS hi,
          last_value(a_end IGNORE NULLS) OVER bef AS lo_end, first_value(a_start IGNORE NULLS) OVER aft AS hi_start
        FROM al0 WINDOW bef AS (PARTITION BY clip_id, chunk_idx, phrase_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        aft AS (PARTITION BY clip_id, chunk_idx, phrase_idx ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
al2 AS (SELECT *, coalesce(lo_end, b0) AS t0, greatest(0, coalesce(hi_start, bn) - coalesce(lo_end, b0)) AS width, coalesce(lo, -1) + 1 AS gs, greatest(1, coalesce(hi, m) - coalesce(lo, -1) - 1) AS size FROM al1),
al AS (SELECT clip_id, chunk_idx, phrase_idx, i AS word_idx, word,
         CASE WHEN b0 IS NULL THEN start_s + cast(i AS DOUBLE) / m * (end_s - start_s) ELSE coalesce(a_start, t0 + cast(i - gs AS DOUBLE) / size * width) END AS start_s,
         CASE WHEN b0 IS NULL THEN start_s + cast(i + 1 AS DOUBLE) / m * (end_s - start_s) ELSE coalesce(a_end, t0 + cast(i - gs + 1 AS DOUBLE) / size * width) END AS end_s,
         a_start IS NOT NULL AS anchored FROM al2)"""

_LETTER = "[" + ", ".join(f"'{x}'" for x in LETTERS) + "]"
_SCRIPTED = f"sc AS (SELECT clip_id, turn, i, word || {_LETTER}[i % 10 + 1] || {_LETTER}[cast(floor(i / 7) AS BIGINT) % 10 + 1] AS word FROM words)"
_LOCALE = "CASE " + " ".join(f"WHEN regexp_matches(word, '[{chr(a)}-{chr(a + 0x7F)}]') THEN '{x}'" for x, a in SCRIPTS) + " END"


def _case(expr: str, pairs: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _roman(w: str, keep: str = r"a-zA-Z0-9\s.,!?''-") -> str:
    """A mark after every consonant, taken back before a sign, then letter by letter."""
    mark = chr(0xE000)
    out = f"regexp_replace({w}, '([{''.join(CONSONANTS)}])', '\\1{mark}', 'g')"
    for s in SIGNS:
        out = f"replace({out}, '{mark}{s}', '{s}')"
    for a, b in (CONSONANTS | VOWELS | SIGNS | CODAS | {mark: "a"}).items():
        out = f"replace({out}, '{a}', '{b}')"
    return rf"lower(regexp_replace({out}, '[^{keep}]', '', 'g'))"


_SLOTS = """
bx AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY slot_index, id) - 1 AS slot FROM crop_boxes),
sl AS (SELECT s.id AS segment_id, s.clip_id, s.sort_order, s.layout, s.start_ms, s.end_ms, x.slot, b.id AS box_id, b.source_video_id AS src, b.source_offset_ms AS off
       FROM segments s JOIN (SELECT unnest([0, 1, 2]) AS slot) x ON x.slot < CASE s.layout WHEN 'split' THEN 2 WHEN 'trio' THEN 3 ELSE 1 END
       LEFT JOIN bx b ON b.segment_id = s.id AND b.slot = x.slot),
known AS (SELECT sl.*, v.video_id AS source_video_id FROM sl LEFT JOIN (SELECT video_id FROM videos WHERE storage_path <> '') v ON v.video_id = sl.src)"""
_VALID = """
kf AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN -4611686018427387904 ELSE t_ms END AS lo, coalesce(lead(t_ms) OVER w, 4611686018427387904) AS hi
       FROM box_keyframes WINDOW w AS (PARTITION BY box_id ORDER BY t_ms, kf_seq))"""
_PCT = r"cast(round(5 + try_cast(regexp_extract(line, '\[download\]\s+([\d.]+)%', 1) AS DOUBLE) * 0.4) AS BIGINT)"


def _present(k: str) -> str:
    return f"json_exists(payload, '$.{k}')"


_ROUTED = f"""
jr AS (SELECT *, coalesce(json_extract_string(payload, '$.storage_path'), '') = '' AS is_link, coalesce(json_extract_string(payload, '$.is_retranscribe'), 'false') = 'true' AS is_retranscribe,
       coalesce(json_extract_string(payload, '$.clip_id'), '') <> '' AND {_present("clip_start_ms")} AND {_present("clip_end_ms")} AS is_clip FROM jobs)"""

_SPEC = """SELECT e.clip_id, coalesce(sg.v, '') AS segments, coalesce(cs.v, '') AS styles, coalesce(tx.v, '') AS texts, coalesce(tr.v, '') AS tracks, coalesce(ts.v, '') AS transitions, coalesce(ov.v, '') AS overlays,
  sha256(coalesce(wd.v, '')) AS words_sha256, coalesce(wd.n, 0) AS n_words, CASE WHEN e.clip_id % 2 = 0 THEN 720 ELSE 1080 END AS output_width
FROM e LEFT JOIN sg USING (clip_id) LEFT JOIN cs USING (clip_id) LEFT JOIN tx USING (clip_id) LEFT JOIN tr USING (clip_id) LEFT JOIN ts USING (clip_id) LEFT JOIN ov USING (clip_id) LEFT JOIN wd USING (clip_id)"""
_SPEC_PARTS = """e AS (SELECT clip_id FROM segments UNION SELECT clip_id FROM clips UNION SELECT clip_id FROM overlays UNION SELECT clip_id FROM audio_tracks),
fr AS (SELECT box_id, string_agg(kf_seq || '@' || t_ms || ':' || cast(round(x * 1000000) AS BIGINT), ',' ORDER BY t_ms, kf_seq) AS v FROM dealt_keyframes GROUP BY 1),
bs AS (SELECT segment_id, string_agg(b.id || '/' || coalesce(cast(source_video_id AS VARCHAR), '') || '(' || coalesce(fr.v, '') || ')', ',' ORDER BY slot_index, b.id) AS v FROM crop_boxes b LEFT JOIN fr ON fr.box_id = b.id GROUP BY segment_id),
sg AS (SELECT clip_id, string_agg(s.id || '[' || coalesce(bs.v, '') || ']', ';' ORDER BY sort_order, s.id) AS v FROM segments s LEFT JOIN bs ON bs.segment_id = s.id GROUP BY clip_id),
cs AS (SELECT clip_id, clip_id || ':' || CASE WHEN clip_id % 2 = 0 THEN 'roboto' ELSE '' END AS v FROM clips),
tx AS (SELECT clip_id, string_agg(id || ':text ' || id, ',' ORDER BY id) AS v FROM overlays WHERE id % 2 = 1 GROUP BY clip_id),
tr AS (SELECT clip_id, string_agg(id || ':' || seek_ms, ',' ORDER BY id) AS v FROM audio_tracks GROUP BY clip_id),
ts AS (SELECT clip_id, string_agg(id || ':' || CASE WHEN sort_order % 2 = 0 THEN 'cut' ELSE 'fade' END, ',' ORDER BY id) AS v FROM segments WHERE sort_order > 1 GROUP BY clip_id),
ov AS (SELECT clip_id, string_agg(z_index || ':' || id, ',' ORDER BY z_index, id) AS v FROM overlays WHERE id % 2 = 0 GROUP BY clip_id),
nw AS (SELECT video_id, arg_max(clip_id, struct_pack(a := start_ms % 10000, b := clip_id)) AS transcript_id FROM clips GROUP BY video_id),
wd AS (SELECT c.clip_id, string_agg(w.start_ms || ':' || w.word, ' ' ORDER BY w.start_ms, w.turn, w.i) AS v, count(*) AS n FROM clips c JOIN nw USING (video_id) JOIN words w ON w.clip_id = nw.transcript_id
       WHERE w.end_ms >= c.start_ms AND w.start_ms <= c.end_ms GROUP BY c.clip_id)"""

ORACLES = {
    "caption_events": duck("SELECT clip_id, line, start_ms, end_ms, text FROM ev WHERE trim(text) <> ''", _lines("words")),
    "clip_captions": duck(
        f"SELECT clip_id, line, {_time('start_ms')} AS start_time, {_time('end_ms')} AS end_time, text FROM ev WHERE trim(text) <> ''",
        """newest AS (SELECT video_id, arg_max(clip_id, struct_pack(a := start_ms % 10000, b := clip_id)) AS transcript_id FROM clips GROUP BY video_id),
cw AS (SELECT c.clip_id, w.turn, w.i, w.word, w.start_ms - c.start_ms AS start_ms, w.end_ms - c.start_ms AS end_ms
       FROM clips c JOIN newest n USING (video_id) JOIN words w ON w.clip_id = n.transcript_id WHERE w.end_ms >= c.start_ms AND w.start_ms <= c.end_ms),""" + _lines("cw"),
    ),
    "caption_scripts": duck(
        rf"""SELECT clip_id, n, line FROM (
  SELECT clip_id, line + 1000 AS n, 'Dialogue: 0,' || {_time("start_ms")} || ',' || {_time("end_ms")} || ',Default,,0,0,0,,{{\pos(540,' || cast(trunc(CASE WHEN clip_id % 5 = 0 THEN 0.84 ELSE clip_id % 5 / cast(5 AS DOUBLE) END * 1920) AS INT) || ')}}' || text AS line
  FROM ev WHERE trim(text) <> ''
  UNION ALL
  SELECT clip_id, unnest(range(14)) AS n, unnest(['[Script Info]', 'ScriptType: v4.00+', 'PlayResX: 1080', 'PlayResY: 1920', 'WrapStyle: 0', 'ScaledBorderAndShadow: yes', '', '[V4+ Styles]',
    'Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding',
    'Style: Default,' || CASE WHEN clip_id % 3 = 0 THEN 'Roboto' ELSE 'Noto Sans Telugu' END || ',' || CASE WHEN clip_id % 4 = 0 THEN 52 ELSE clip_id % 4 * 10 END || ',' || CASE WHEN clip_id % 2 = 0 THEN '&H00FFAA11' ELSE '&H000C0B0A' END || ',&H00FFFFFF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,3,2,5,10,10,10,1',
    '', '[Events]', 'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text', NULL]) AS line
  FROM (SELECT DISTINCT clip_id FROM ev WHERE trim(text) <> '')) WHERE line IS NOT NULL""",
        _lines("words"),
    ),
    "word_end_clamp": duck(
        """SELECT clip_id, turn, i, cast(round(1000 * CASE WHEN nxt IS NULL THEN CASE WHEN e < total THEN total ELSE e END ELSE least(nxt, s + 4.0) END) AS BIGINT) AS end_ms FROM c""",
        """t AS (SELECT clip_id, (max(end_ms) + 1500 * (clip_id % 2) - 100) / cast(1000 AS DOUBLE) AS total FROM words GROUP BY clip_id),
c AS (SELECT clip_id, turn, i, total, start_ms / cast(1000 AS DOUBLE) AS s, end_ms / cast(1000 AS DOUBLE) AS e, lead(start_ms / cast(1000 AS DOUBLE)) OVER (PARTITION BY clip_id ORDER BY turn, i) AS nxt FROM words JOIN t USING (clip_id))""",
    ),
    "even_split": duck(
        """SELECT clip_id, chunk_idx, phrase_idx, i AS word_idx, word, cast(round((start_s + cast(i AS DOUBLE) / m * (end_s - start_s)) * 1000) AS BIGINT) AS start_ms, cast(round((start_s + cast(i + 1 AS DOUBLE) / m * (end_s - start_s)) * 1000) AS BIGINT) AS end_ms FROM tk""",
        _TOKENS,
    ),
    "overlap_join": duck("SELECT clip_id, chunk_idx, phrase_idx, anchor_idx, j, n FROM ov", _OVERLAPS),
    "align_anchor": duck("SELECT * FROM hit", _MATCHES),
    "align_fill": duck("SELECT clip_id, chunk_idx, phrase_idx, word_idx, word, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, anchored FROM al", _ALIGNED),
    "align_quality": duck("SELECT clip_id, count(*) FILTER (WHERE anchored) AS anchored_words, count(*) FILTER (WHERE NOT anchored) AS filled_words FROM al GROUP BY clip_id", _ALIGNED),
    "transcript_build": duck(
        """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY chunk_idx, phrase_idx, word_idx) - 1 AS word_idx, word,
  CASE WHEN language = 'te-IN' AND regexp_matches(word, '[a-zA-Z]') THEN lower(word) END AS word_roman, cast(round(s * 1000) AS BIGINT) + 1000 AS start_ms,
  cast(round(1000 * CASE WHEN nxt IS NULL THEN CASE WHEN e < total THEN total ELSE e END ELSE least(nxt, s + 4.0) END) AS BIGINT) + 1000 AS end_ms, language FROM c""",
        _ALIGNED + """,
tot AS (SELECT clip_id, max(end_s + chunk_idx * 25) + 1 AS total FROM asr_phrases GROUP BY clip_id),
lg AS (SELECT clip_id, coalesce(arg_max(CASE WHEN clip_id % 2 = 0 THEN 'te-IN' ELSE 'hi' END, chunk_idx) FILTER (WHERE chunk_idx % 3 <> 2), 'unknown') AS language FROM asr_phrases GROUP BY clip_id),
c AS (SELECT al.*, start_s + chunk_idx * 25 AS s, end_s + chunk_idx * 25 AS e, total, language, lead(start_s + chunk_idx * 25) OVER (PARTITION BY clip_id ORDER BY chunk_idx, phrase_idx, word_idx) AS nxt FROM al JOIN tot USING (clip_id) JOIN lg USING (clip_id))""",
    ),
    "similar_words": duck(f"SELECT clip_id, turn, i, {_normal('word')} AS normal, {_alike('word', 'after')} AS alike FROM p WHERE after IS NOT NULL", "p AS (SELECT clip_id, turn, i, word, lead(word) OVER (PARTITION BY clip_id, turn ORDER BY i) AS after FROM words)"),
    "keyframe_asof": duck("SELECT p.box_id, p.event_id, round(coalesce(x, 0), 9) AS x, round(coalesce(y, 0), 9) AS y, round(coalesce(w, 1), 9) AS w, round(coalesce(h, 1), 9) AS h FROM probes p LEFT JOIN kf ON p.box_id = kf.box_id AND q_ms >= lo AND q_ms < hi", _VALID),
    "crop_track": duck(
        """SELECT segment_id, slot, greatest(s, coalesce(lo, s)) AS start_ms, least(e, coalesce(hi, e)) AS end_ms, round(least(1078, coalesce(x, 0) * 1080), 6) AS crop_x, round(least(1918, coalesce(y, 0) * 1920), 6) AS crop_y,
  round(greatest(2, coalesce(w, 1) * 1080), 6) AS crop_w, round(greatest(2, coalesce(h, 1) * 1920), 6) AS crop_h FROM z LEFT JOIN kf ON z.box = kf.box_id AND lo < hi AND lo < e AND hi > s""",
        _VALID + "," + _SLOTS + ",\nz AS (SELECT segment_id, slot, box_id % 150 AS box, 1704067200000 + segment_id % 600 * 3600000 + start_ms * 500 AS s, 1704067200000 + segment_id % 600 * 3600000 + end_ms * 500 AS e FROM sl)",
    ),
    "overlays_at_time": duck("SELECT p.box_id AS clip_id, p.event_id, o.id, o.z_index FROM probes p JOIN overlays o ON o.clip_id = p.box_id AND p.q_ms BETWEEN o.start_ms AND o.end_ms"),
    "karaoke_line": duck(
        """SELECT t.clip_id, t.t_ms, t.i, coalesce((SELECT arg_min(sentence, seq) FROM s WHERE s.clip_id = t.clip_id AND start_ms <= t.t_ms AND t.t_ms < end_ms),
  (SELECT CASE WHEN arg_min(start_ms, seq) - t.t_ms < 500 THEN arg_min(sentence, seq) END FROM s WHERE s.clip_id = t.clip_id AND start_ms > t.t_ms)) AS sentence FROM caption_times t""",
        r"""s0 AS (SELECT *, coalesce(lag(regexp_matches(word, '[.!?।]$')) OVER w, false) AS new, row_number() OVER w AS seq FROM words WINDOW w AS (PARTITION BY clip_id ORDER BY turn, i)),
s AS (SELECT clip_id, seq, start_ms, end_ms, cast(sum(cast(new AS INT)) OVER (PARTITION BY clip_id ORDER BY seq) AS BIGINT) AS sentence FROM s0)""",
    ),
    "visible_words": duck("SELECT t.clip_id, t.t_ms, w.turn, w.i, w.word FROM caption_times t JOIN words w ON w.clip_id = t.clip_id AND w.start_ms <= t.t_ms AND t.t_ms < w.end_ms + 500"),
    "sampled_state": duck(
        """SELECT g.clip_id, g.t_ms, coalesce(n.n, 0) AS n_words,
  coalesce((SELECT arg_min(sentence, seq) FROM s WHERE s.clip_id = g.clip_id AND start_ms <= g.t_ms AND g.t_ms < end_ms),
    (SELECT CASE WHEN arg_min(start_ms, seq) - g.t_ms < 500 THEN arg_min(sentence, seq) END FROM s WHERE s.clip_id = g.clip_id AND start_ms > g.t_ms)) AS sentence,
  round(coalesce(x, 0), 9) AS x, round(coalesce(y, 0), 9) AS y, round(coalesce(w, 1), 9) AS w, round(coalesce(h, 1), 9) AS h, coalesce(o.layers, '') AS layers
FROM g LEFT JOIN n USING (clip_id, t_ms) LEFT JOIN o USING (clip_id, t_ms) LEFT JOIN kf ON kf.box_id = g.clip_id % 150 AND g.q >= lo AND g.q < hi""",
        r"""g AS (SELECT clip_id, t_ms, 1704067200000 + t_ms * 8640 AS q FROM (SELECT clip_id, unnest(range(0, end_ms - start_ms, 10000)) AS t_ms FROM clips)),
cw AS (SELECT w.clip_id, w.turn, w.i, w.word, w.start_ms - c.start_ms AS start_ms, w.end_ms - c.start_ms AS end_ms FROM words w JOIN clips c USING (clip_id) WHERE w.end_ms >= c.start_ms AND w.start_ms <= c.end_ms),
s0 AS (SELECT *, coalesce(lag(regexp_matches(word, '[.!?।]$')) OVER w, false) AS new, row_number() OVER w AS seq FROM cw WINDOW w AS (PARTITION BY clip_id ORDER BY turn, i)),
s AS (SELECT clip_id, seq, start_ms, end_ms, cast(sum(cast(new AS INT)) OVER (PARTITION BY clip_id ORDER BY seq) AS BIGINT) AS sentence FROM s0),
n AS (SELECT g.clip_id, g.t_ms, count(*) AS n FROM g JOIN cw ON cw.clip_id = g.clip_id AND cw.start_ms <= g.t_ms AND g.t_ms < cw.end_ms + 500 GROUP BY ALL),
o AS (SELECT g.clip_id, g.t_ms, string_agg(v.id, ',' ORDER BY v.z_index, v.id) AS layers FROM g JOIN overlays v ON v.clip_id = g.clip_id AND g.q BETWEEN v.start_ms AND v.end_ms GROUP BY ALL),"""
        + _VALID,
    ),
    "clip_spec": duck(_SPEC, _SPEC_PARTS),
    "spec_json": duck(_SPEC, _SPEC_PARTS),
    "cut_list": duck(
        """SELECT clip_id, segment_id, sort_order, slot, box_id, source_video_id, CASE WHEN source_video_id IS NOT NULL THEN coalesce(off, 0) ELSE start_ms END AS in_ms,
  CASE WHEN source_video_id IS NOT NULL THEN coalesce(off, 0) + end_ms - start_ms ELSE end_ms END AS out_ms, 0 AS dst_x, CASE layout WHEN 'split' THEN 960 WHEN 'trio' THEN 640 ELSE 1920 END * slot AS dst_y, 1080 AS dst_w,
  CASE layout WHEN 'split' THEN 960 WHEN 'trio' THEN 640 ELSE 1920 END AS dst_h, CASE layout WHEN 'horizontal' THEN 'fit' ELSE 'cover' END AS fit, start_ms AS clip_start_ms, output_start_ms
FROM known JOIN (SELECT id, cast(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY clip_id ORDER BY sort_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS output_start_ms FROM segments) o ON o.id = segment_id""",
        _SLOTS,
    ),
    "source_counts": duck("SELECT clip_id, source_video_id, count(*) AS n_slots FROM known GROUP BY ALL", _SLOTS),
    "asset_manifest": duck(
        """SELECT DISTINCT clip_id, kind, key, sha256(key) AS name FROM (
  SELECT clip_id, 'source' AS kind, 'raw/c' || clip_id AS key FROM clips
  UNION ALL SELECT b.clip_id, 'secondary', v.storage_path FROM crop_boxes b JOIN videos v ON v.video_id = b.source_video_id
  UNION ALL SELECT clip_id, 'overlay', 'ov/' || (id % 50) || '.png' FROM overlays WHERE id % 2 = 0
  UNION ALL SELECT clip_id, 'music', 'music/' || (id % 30) FROM audio_tracks) WHERE key <> ''"""
    ),
    "overlay_geometry": duck(
        """SELECT id, 'image' AS kind, cast(trunc(coalesce(CASE WHEN id % 3 > 0 THEN id % 17 / cast(16 AS DOUBLE) END, 0) * 1080) AS BIGINT) AS px, cast(trunc(coalesce(CASE WHEN id % 4 > 0 THEN id % 9 / cast(8 AS DOUBLE) END, 0) * 1920) AS BIGINT) AS py,
  greatest(1, cast(trunc(coalesce(CASE WHEN id % 5 > 0 THEN id % 5 / cast(1024 AS DOUBLE) END, cast(0.2 AS DOUBLE)) * 1080) AS BIGINT)) AS pw, cast(trunc(cast(0.2 AS DOUBLE) * 1920) AS BIGINT) AS ph FROM overlays
UNION ALL SELECT id, 'text', cast(trunc(CASE WHEN id % 3 > 0 AND id % 17 > 0 THEN id % 17 / cast(16 AS DOUBLE) ELSE cast(0.1 AS DOUBLE) END * 1080) AS BIGINT), cast(trunc(CASE WHEN id % 4 > 0 AND id % 9 > 0 THEN id % 9 / cast(8 AS DOUBLE) ELSE cast(0.1 AS DOUBLE) END * 1920) AS BIGINT), 48, 0 FROM overlays WHERE id % 2 = 0"""
    ),
    "latest_transcript": duck("SELECT id, video_id, language FROM transcripts QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) = 1"),
    "replace_transcripts": duck("SELECT id, video_id, language FROM transcripts WHERE id % 3 <> 0 AND video_id NOT IN (SELECT video_id FROM transcripts WHERE id % 3 = 0) UNION ALL SELECT id, video_id, language FROM transcripts WHERE id % 3 = 0"),
    "table_round_trip": duck(
        "SELECT cast(id AS VARCHAR) AS id, cast(video_id AS VARCHAR) AS video_id, language, way FROM r CROSS JOIN (SELECT unnest(['replaced', 'keyed', 'bucketed']) AS way)",
        "r AS (SELECT * FROM transcripts WHERE id % 3 = 2 OR video_id NOT IN (SELECT video_id FROM transcripts WHERE id % 3 = 2))",
    ),
    "music_gain": duck(
        """SELECT id, clip_id, t AS start_ms, nxt AS end_ms, round(CASE WHEN inside > 0 THEN volume * 0.15 ELSE volume END, 6) AS gain, seek_ms
FROM (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY t) AS nxt, sum(step) OVER (PARTITION BY id ORDER BY t) AS inside FROM e) JOIN audio_tracks USING (id) WHERE nxt IS NOT NULL""",
        _RANGES + """,
cr AS (SELECT t.id, greatest(r.start_ms - c.start_ms, 0) AS s, least(r.end_ms - c.start_ms, 300000) AS f FROM audio_tracks t JOIN clips c USING (clip_id) JOIN ranges r USING (clip_id) WHERE t.duck AND r.end_ms >= c.start_ms AND r.start_ms <= c.end_ms),
e AS (SELECT id, t, sum(step) AS step FROM (SELECT id, s AS t, 1 AS step FROM cr WHERE s < 300000 AND f > s UNION ALL SELECT id, f, -1 FROM cr WHERE s < 300000 AND f > s
      UNION ALL SELECT id, 0, 0 FROM audio_tracks JOIN clips USING (clip_id) UNION ALL SELECT id, 300000, 0 FROM audio_tracks JOIN clips USING (clip_id)) GROUP BY id, t)""",
    ),
    "script_detect": duck(f"SELECT clip_id, turn, i, {_LOCALE} AS locale FROM sc", _SCRIPTED),
    "lang_codes": duck(
        f"""SELECT clip_id, turn, i, coalesce({_case("lower(code)", SHORT_CODES)}, lower(split_part(code, '-', 1))) AS short, coalesce(CASE WHEN contains(code, '-') THEN code END, {_case("code", LOCALES)}, {_LOCALE}) AS locale
FROM (SELECT *, [{", ".join(f"'{x}'" for x in CODES)}][i % {len(CODES)} + 1] AS code FROM sc)""",
        _SCRIPTED,
    ),
    "romanize_telugu": duck(f"SELECT clip_id, turn, i, telugu, {_roman('telugu')} AS roman FROM (SELECT clip_id, turn, i, translate(lower(word), '{TO_TELUGU[0]}', '{TO_TELUGU[1]}') AS telugu FROM words)"),
    "display_words": duck(
        r"""SELECT clip_id, turn, i, CASE WHEN i % 3 = 1 THEN lower(word) ELSE word END AS shown, strip_accents(lower(word)) AS plain, regexp_matches(word, '[.!?।]\s*$') AS ends,
  CASE WHEN NOT regexp_matches(translate(word, '.,!?।', ''), '[^\x00-\x7F]') THEN nullif(trim(translate(lower(word), '.,!?।', '')), '') END AS ascii_roman FROM words"""
    ),
    "marker_batches": duck(
        r"""SELECT clip_id, p // 20 AS batch, p % 20 AS pos, word, CASE WHEN regexp_matches(c, '[a-zA-Z]') THEN c END AS roman
FROM (SELECT clip_id, word, trim(translate(word, '.,!?।[]', '')) AS c, row_number() OVER (PARTITION BY clip_id ORDER BY turn, i) - 1 AS p FROM words)"""
    ),
    "model_list_decode": duck(
        """SELECT clip_id, turn, unnest(CASE WHEN items IS NULL THEN [NULL] ELSE range(len(items)) END) AS pos, unnest(CASE WHEN items IS NULL THEN [NULL] ELSE items END) AS item FROM (
  SELECT clip_id, turn, CASE WHEN (clip_id + turn) % 5 < 3 THEN list_append(ws, NULL) WHEN (clip_id + turn) % 5 = 3 THEN ws END AS items
  FROM (SELECT clip_id, turn, list(word ORDER BY i) AS ws FROM words GROUP BY clip_id, turn))"""
    ),
    "script_words": duck(
        f"SELECT clip_id, turn, i, coalesce(nullif(roman, ''), CASE WHEN regexp_matches(word, '[{chr(0x0C00)}-{chr(0x0C7F)}]') THEN {_roman('word', keep=chr(92) + 'x00-' + chr(92) + 'x7F')} ELSE word END) AS shown FROM sw",
        f"sw AS (SELECT clip_id, turn, i, CASE WHEN i % 2 = 0 THEN translate(lower(word), '{TO_TELUGU[0]}', '{TO_TELUGU[1]}') ELSE word END AS word, CASE i % 3 WHEN 0 THEN lower(word) WHEN 1 THEN '' END AS roman FROM words)",
    ),
    "job_routes": duck("SELECT id, is_link, is_retranscribe, is_clip, CASE WHEN NOT is_clip AND NOT is_retranscribe AND NOT is_link THEN 'mark_ready' WHEN NOT is_clip AND NOT is_retranscribe THEN 'fetch_only' ELSE 'transcribe' END AS route FROM jr", _ROUTED),
    "audio_ranges": duck("SELECT id, cast(json_extract_string(payload, '$.clip_start_ms') AS BIGINT) / cast(1000 AS DOUBLE) AS start_s, (cast(json_extract_string(payload, '$.clip_end_ms') AS BIGINT) - cast(json_extract_string(payload, '$.clip_start_ms') AS BIGINT)) / cast(1000 AS DOUBLE) AS length_s FROM jr WHERE is_clip", _ROUTED),
    "encode_plan": duck(
        """SELECT video_id, cast(round(p * 1000) AS BIGINT) AS duration_ms, regexp_replace(storage_path, '\\.[^.]+$', '_audio.flac') AS audio_key, 'raw/' || user_id || '/' || video_id || '.mp4' AS raw_key, least(src, 1800.0) AS duration_s,
  kb AS video_kbps, cast(floor(kb * cast(1.5 AS DOUBLE) + 0.5) AS BIGINT) AS maxrate_kbps, kb * 3 AS bufsize_kbps, src > 1800 AS trimmed
FROM (SELECT *, greatest(80, cast(floor(360448 / least(src, 1800.0)) AS BIGINT) - 96) AS kb FROM (SELECT *, try_cast(probe_s AS DOUBLE) AS p, coalesce(nullif(try_cast(probe_s AS DOUBLE), 0), cast(60 AS DOUBLE)) AS src FROM videos))"""
    ),
    "progress_changes": duck(f"SELECT video_id, line_no, progress FROM (SELECT *, coalesce(lag(progress) OVER (PARTITION BY video_id ORDER BY line_no), 0) AS b FROM p WHERE progress IS NOT NULL) WHERE progress <> b", f"p AS (SELECT video_id, line_no, {_PCT} AS progress FROM log_lines)"),
    "backlog": duck("SELECT id, type, place FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at, id) AS place FROM jobs WHERE status = 'queued') WHERE place <= 20"),
    "status_fold": duck(
        "SELECT v.video_id, coalesce(e.status, 'new') AS status, coalesce(e.progress, 0) AS progress FROM videos v LEFT JOIN e USING (video_id)",
        f"e AS (SELECT video_id, max(CASE WHEN line_no % 3 = 0 THEN 'downloading' END) AS status, arg_max({_PCT}, line_no) FILTER (WHERE {_PCT} IS NOT NULL) AS progress FROM log_lines GROUP BY video_id)",
    ),
    "chunk_plan": duck("SELECT clip_id, c AS chunk_idx, cast(c * 25 AS DOUBLE) AS start_s, cast(25 AS DOUBLE) AS length_s, cast(round(63 + cast(c AS DOUBLE) / n * 33) AS BIGINT) AS progress FROM (SELECT clip_id, n, unnest(range(n)) AS c FROM (SELECT clip_id, cast(ceil(max(end_ms) / cast(25000 AS DOUBLE)) AS BIGINT) AS n FROM words GROUP BY clip_id))"),
    "chunk_languages": duck(
        """SELECT h.clip_id, chunk_idx, coalesce(given, CASE WHEN chunk_idx > 0 THEN f.lang END, 'unknown') AS request_lang, coalesce(l.lang, 'unknown') AS language
FROM h LEFT JOIN (SELECT clip_id, arg_min(coalesce(nullif(nullif(lang, ''), 'unknown'), '?'), chunk_idx) AS lang0, CASE WHEN lang0 <> '?' THEN lang0 END AS lang FROM h GROUP BY clip_id) f USING (clip_id)
LEFT JOIN (SELECT clip_id, arg_max(lang, chunk_idx) AS lang FROM h WHERE lang NOT IN ('', 'unknown') GROUP BY clip_id) l USING (clip_id)""",
        "h AS (SELECT DISTINCT clip_id, chunk_idx, ['unknown', 'te-IN', '', 'hi'][(clip_id + chunk_idx) % 4 + 1] AS lang, CASE WHEN clip_id % 3 = 0 THEN 'ta-IN' END AS given FROM asr_phrases)",
    ),
    "answer_rows": duck(
        """SELECT * FROM (SELECT clip_id, chunk_idx, count(*) AS n_words, arg_max(end_s, anchor_idx) AS last_end_s, coalesce(string_agg(word, ' ' ORDER BY anchor_idx) FILTER (WHERE k < 3), '') AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, chunk_idx ORDER BY anchor_idx) - 1 AS k FROM asr_anchors) GROUP BY clip_id, chunk_idx)
JOIN (SELECT clip_id, chunk_idx, count(*) AS n_phrases, greatest(count(*) - 2, 0) AS n_untimed FROM asr_phrases GROUP BY clip_id, chunk_idx) USING (clip_id, chunk_idx)"""
    ),
}
ORACLES["speech_ranges"] = duck("SELECT * FROM ranges", _RANGES)
ORACLES["speech_ranges_session"] = ORACLES["speech_ranges"]
ORACLES["stream_speech_ranges"] = ORACLES["speech_ranges"]
ORACLES["stream_answers"] = duck("SELECT cast(clip_id AS VARCHAR) AS clip_id, chunk_idx, row_number() OVER (PARTITION BY clip_id, chunk_idx ORDER BY phrase_idx) - 1 AS phrase_idx, phrase, start_s, end_s FROM asr_phrases")
ORACLES["stream_progress"] = ORACLES["progress_changes"]
ORACLES["endless_overlays"] = duck("SELECT p.box_id AS clip_id, p.event_id, o.id FROM probes p JOIN overlays o ON o.clip_id = p.box_id AND p.q_ms >= o.start_ms AND (o.id % 7 = 0 OR p.q_ms <= o.end_ms)")
for _name in ("caption_events", "speech_ranges", "word_end_clamp"):
    ORACLES[f"{_name}_in_stretches"] = ORACLES[_name]
