"""Timed words, clips, segments and the like, derived from the base tables by one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: By what Spark deals out tables: segments and boxes then lie by clip.
DEALT = {"lineitem": "l_orderkey"}
#: Rows of a task of such a table, about, and the rows of those that were counted.
DEALT_ROWS = 1 << 17
_rows: dict[tuple[str, str, str], int] = {}

#: What the engines write differently.
TOKENS = {
    "spark": {
        "TOK": r"select conv_id clip_id, turn, cast(p as bigint) i, word from (select conv_id, turn, posexplode(split(trim(regexp_replace(text, r'\s+', ' ')),' ')) as (p,word) from conversations)",
        "JOINW": "array_join(transform(array_sort(collect_list(named_struct('i',i,'w',word))), x -> x.w),' ')",
        "MS": "cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)/1000) as bigint)",
    },
    "duckdb": {
        "TOK": r"select conv_id clip_id, turn, unnest(range(len(w))) i, unnest(w) word from (select conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')),' ') w from conversations)",
        "JOINW": "string_agg(word,' ' order by i)",
        "MS": "cast(floor(epoch_us(ts)/1000) as bigint)",
    },
}

VIEWS = {
    "words": """with tk as ({TOK})
 select clip_id, turn, i, word,
  turn*150000 + i*260 + 250*cast(floor(i/3) as bigint) + 700*cast(floor(i/11) as bigint) start_ms,
  turn*150000 + i*260 + 250*cast(floor(i/3) as bigint) + 700*cast(floor(i/11) as bigint) + 60 + 20*(length(word)%10) end_ms
 from tk where word<>''""",
    "asr_phrases": """select clip_id, turn chunk_idx, cast(floor(i/8) as bigint) phrase_idx, {JOINW} phrase, min(start_ms)/cast(1000 as double) start_s, max(end_ms)/cast(1000 as double) end_s
 from words group by clip_id, turn, cast(floor(i/8) as bigint)""",
    "asr_anchors": """select clip_id, turn chunk_idx, i anchor_idx, case when i%4=1 then substring(word,1,length(word)-1)||'x' else word end word, start_ms/cast(1000 as double) start_s, end_ms/cast(1000 as double) end_s
 from words where i%5<>3""",
    "clips": "select distinct conv_id clip_id, conv_id%20 video_id, 5000*(conv_id%7) start_ms, 5000*(conv_id%7)+300000 end_ms from conversations",
    "videos": """select s_suppkey video_id, s_nationkey user_id, case when s_suppkey%10=0 then '' else 'raw/'||cast(s_nationkey as string)||'/'||cast(s_suppkey as string)||'.mp4' end storage_path,
  case when s_suppkey%13=0 then 'N/A' else cast(s_suppkey*37 as string)||'.5' end probe_s from supplier""",
    "transcripts": "select o_orderkey id, o_custkey video_id, case o_orderstatus when 'P' then 'te-IN' when 'F' then 'hi-IN' else 'unknown' end language, o_orderdate created_at from orders",
    "segments": """select l_orderkey*10+l_linenumber id, l_orderkey clip_id, l_linenumber sort_order, min(l_partkey) k,
  case min(l_partkey)%7 when 0 then 'vertical' when 1 then 'horizontal' when 2 then 'split' when 3 then 'trio' when 4 then 'spotlight' when 5 then 'centered' else 'other' end layout,
  cast(10000*l_linenumber as bigint) start_ms, cast(10000*l_linenumber + 1000*cast(min(l_quantity) as bigint) as bigint) end_ms
 from lineitem group by l_orderkey, l_linenumber""",
    "crop_boxes": """select id*10+j id, id segment_id, cast(30-10*j as int) slot_index, case when (k+j)%3=0 then null else (k+j)%100 end source_video_id, 500*((k+j)%9) source_offset_ms, clip_id
 from segments cross join (values (0),(1),(2)) v(j) where j < k%4""",
    "box_keyframes": """select user_id box_id, event_id kf_seq, {MS} - {MS}%3600000 t_ms, value/1000 x, value/2000 y, cast(0.5 as double) w, cast(0.25 as double) h from events where event_type in ('click','view')""",
    #: The boxes of as many groups of clips as there are users, numbered within each.
    "box_places": """select id, clip_id % (select max(user_id) + 1 from events) grp, row_number() over (partition by clip_id % (select max(user_id) + 1 from events) order by id) - 1 place,
  count(*) over (partition by clip_id % (select max(user_id) + 1 from events)) n from crop_boxes""",
    #: Keyframes dealt over boxes that exist: three in a row to one box, then to the next of the user's group.
    "dealt_keyframes": """select b.id box_id, k.kf_seq, k.t_ms, k.x, k.y, k.w, k.h from box_keyframes k join (select distinct grp, n from box_places) c on c.grp = k.box_id
  join box_places b on b.grp = k.box_id and b.place = cast(floor(k.kf_seq/3) as bigint) % c.n""",
    "probes": "select user_id box_id, event_id, {MS} q_ms from events where event_type in ('error','purchase')",
    "overlays": "select user_id clip_id, event_id id, {MS} start_ms, {MS}+60000*cast(floor(value) as bigint) end_ms, event_id%5 z_index from events where event_type='signup'",
    "audio_tracks": "select s_suppkey id, s_suppkey clip_id, (s_suppkey%10)/cast(10 as double) volume, s_suppkey%2=0 duck, 1000*(s_suppkey%6) seek_ms from supplier",
    "jobs": """select o_orderkey id, o_orderdate created_at, case when o_orderkey%5=0 then 'render' else 'transcribe' end type, case when o_orderkey%4=0 then 'queued' else 'done' end status,
 '{"video_id":"'||cast(o_custkey as string)||'"'||case when o_orderkey%2=0 then ',"storage_path":"raw/a.mp4"' else '' end||case when o_orderkey%3=0 then ',"clip_id":"c1","clip_start_ms":1000,"clip_end_ms":'||case when o_orderkey%9=0 then 'null' else cast(2000+o_orderkey as string) end else '' end||case when o_orderkey%7=0 then ',"is_retranscribe":true' else '' end||'}' payload from orders""",
    "log_lines": """select user_id video_id, event_id line_no, case when event_id%3=0 then '[info] x' else '[download]  '||cast(cast(floor(event_id/100) as bigint)%100 as string)||'.'||cast(event_id%10 as string)||'% of 10MiB' end line from events""",
    #: Times to ask captions about: some inside words, some in gaps.
    "caption_times": "select clip_id, start_ms + 90*(i%9) t_ms, min(i) i from words group by clip_id, start_ms + 90*(i%9)",
}


def _needs(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def _with(engine: str, names: list[str], text: str, base: dict[str, str]) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for other in _needs(_filled(engine, VIEWS[name]), [v for v in VIEWS if v != name]):
                add(other)
            done.append(name)

    for n in names:
        add(n)
    views = {n: _filled(engine, VIEWS[n]) for n in done}
    used = _needs(" ".join([*views.values(), text]), BASE) if base else []
    parts = [f"{t} AS ({base[t]})" for t in used] + [f"{n} AS ({v})" for n, v in views.items()]
    return ",\n".join(parts)


def _filled(engine: str, text: str) -> str:
    for k, v in TOKENS[engine].items():
        text = text.replace("{" + k + "}", v)
    return text


def _parts(spark: SparkSession, sf_dir: str, table: str) -> str:
    """How many tasks a table's rows ask for, as a hint has it; nothing if it is one.  Rows are counted once a session, from the files' footers."""
    at = (spark.sparkContext.applicationId, sf_dir, table)
    if at not in _rows:
        _rows[at] = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    n = -(-_rows[at] // DEALT_ROWS)
    return f"{max(n, spark.sparkContext.defaultParallelism)}, " if n > 1 else ""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``; only the columns that are used are read.

    Tables of ``DEALT`` are dealt out by a column, so that views grouped by it and others, and their joins on it, move no rows again.
    """
    base = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in BASE}
    for t in _needs(_with("spark", [name], "", base), DEALT):
        base[t] = f"SELECT /*+ REPARTITION({_parts(spark, sf_dir, t)}{DEALT[t]}) */ * FROM parquet.`{sf_dir}/{t}.parquet`"
    return spark.sql(f"WITH {_with('spark', [name], '', base)} SELECT * FROM {name}")


def duck(select: str, extra: str = "") -> str:
    """A DuckDB query over the views that it names; ``extra`` are further common table expressions."""
    own = _with("duckdb", _needs(extra + " " + select, VIEWS), "", {})
    parts = [p for p in (own, extra) if p]
    return f"WITH RECURSIVE {', '.join(parts)}\n{select}" if parts else select
