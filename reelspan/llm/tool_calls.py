"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

Calls and results meet in an equi-join on their identifier.  A conversation's own
order is kept wherever the calls that a call depends on stand before it; a call that
has to wait takes the place of the last one it waits for.  Dependencies on later calls
span stretches of a conversation; where such stretches overlap they are one tangle, and
only the calls of tangles take part in the rounds of joins that find those places.
A round drops the links to calls that wait for nothing and, where a call waits for a
single other one, links those who wait for it with that other one directly, so a
chain halves: its rounds grow with the logarithm of its length.  Arguments are checked
as VARIANT values against nested schemas, and written with sorted keys and no white
space.  DataFrame functions only; nothing is collected per conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.llm.scratch import stored, written

#: Positions in a stretch of a conversation.
STRETCH = 4096


@dataclass(frozen=True)
class Schema:
    """What a JSON value has to be.

    ``kind``: object, array, string, integer, number, boolean or any.  ``least`` and ``most``
    bound a number's value, a string's length and an array's size.  ``pattern`` is
    searched for in a string; ``one_of`` lists the allowed scalars as JSON texts.  An object's
    ``fields`` are checked by their own schemas, others are ``unknown`` unless it is ``open``; an
    array's elements by ``items``.  Without ``required`` a value may be missing or null.
    """

    kind: str = "any"
    required: bool = True
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    fields: dict[str, Schema] = field(default_factory=dict)
    items: Schema | None = None
    open: bool = False


#: How the types of VARIANT values start, by kind.
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",), "any": ("",)}
NONE = "array<string>"


def _errors(value: Column, schema: Schema, path: Column) -> Column:
    """What is wrong with a VARIANT value: ``missing``, ``type``, ``range``, ``length``, ``size``, ``pattern``, ``enum`` or ``unknown``, each with its path."""
    say = lambda what: F.concat(F.lit(f"{what}:"), path)
    nothing = F.array().cast(NONE)
    kind = F.schema_of_variant(value)
    right = F.lit(False)
    for k in KINDS[schema.kind]:
        right = right | kind.startswith(k)
    found: list[Column] = []

    def unless(good: Column, what: str) -> None:
        found.append(F.when(good, nothing).otherwise(F.array(say(what))))

    measure, what = {
        "string": (F.length(F.try_variant_get(value, "$", "string")), "length"), "array": (F.size(F.try_variant_get(value, "$", "array<variant>")), "size"),
    }.get(schema.kind, (F.try_variant_get(value, "$", "double"), "range"))
    if schema.least is not None or schema.most is not None:
        low = F.lit(True) if schema.least is None else measure >= schema.least
        unless(low if schema.most is None else low & (measure <= schema.most), what)
    if schema.pattern is not None:
        unless(F.try_variant_get(value, "$", "string").rlike(schema.pattern), "pattern")
    if schema.one_of:
        unless(F.to_json(value).isin(*schema.one_of), "enum")
    if schema.items is not None:
        items = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.flatten(F.transform(items, lambda x, i: _errors(x, schema.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    if schema.kind == "object":
        # As a map, so that any name is a key and none a path.
        own = F.try_variant_get(value, "$", "map<string, variant>")
        below = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
        found += [_errors(F.try_element_at(own, F.lit(name)), s, below(F.lit(name))) for name, s in schema.fields.items()]
        if not schema.open:
            unknown = F.array_except(F.map_keys(own), F.array(*map(F.lit, schema.fields)).cast(NONE))
            found.append(F.transform(unknown, lambda k: F.concat(F.lit("unknown:"), below(k))))
    absent = value.isNull() | (kind == "VOID")
    inside = F.concat(*found) if found else nothing
    return F.when(absent, F.array(say("missing")) if schema.required else nothing).when(~right, F.array(say("type"))).otherwise(inside)


def argument_errors(tool: str | Column, arguments: str | Column, tools: dict[str, Schema]) -> Column:
    """Sorted array of what is wrong: ``json``, ``tool`` (not known), or the errors of the tool's schema.

    Null or broken JSON, or JSON that is no object, is ``json``.
    """
    name = F.col(tool) if isinstance(tool, str) else tool
    value = F.try_parse_json(F.col(arguments) if isinstance(arguments, str) else arguments)
    out = F.when(~F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT"), F.array(F.lit("json")))
    for own, schema in tools.items():
        out = out.when(name == own, F.array_sort(_errors(value, schema, F.lit(""))))
    return out.otherwise(F.array(F.lit("tool")))


def _tangles(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, at, reach, tangle`` of calls with the furthest call that each depends on (``reach``, itself if none is later).

    A tangle starts at a call that no earlier one reaches; its name is that call's ``at``.  Running
    maxima go by stretches of ``STRETCH`` positions and then over the stretches, so a long conversation is no single task.
    """
    stretch = calls.withColumn("_s", F.floor(F.col("at.p") / STRETCH))
    inside = Window.partitionBy("conv_id", "_s").orderBy("at")
    over = Window.partitionBy("conv_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(rows: DataFrame, value: str, name: str, last: int) -> DataFrame:
        ahead = rows.groupBy("conv_id", "_s").agg(F.max(value).alias("_m")).select("conv_id", "_s", F.max("_m").over(over).alias("_ahead"))
        here = F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, last))
        own = [c for c in rows.columns if c not in ("conv_id", "_s")]
        return rows.withColumn(name, here).join(ahead, ["conv_id", "_s"]).select("conv_id", "_s", *own, F.greatest(name, "_ahead").alias(name))

    reached = so_far(stretch, "reach", "_before", -1)
    starts = reached.withColumn("_start", F.when(F.col("_before").isNull() | (F.col("_before") < F.col("at")), F.col("at"))).drop("_before")
    return so_far(starts, "_start", "tangle", 0).select("conv_id", "call_id", "at", "reach", "tangle")


def ordered(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, after_position, after_call, wave`` of calls ``conv_id, call_id, position, depends_on``.

    Sorted by (after_position, after_call, wave, position, call_id) every call
    follows those it depends on.  A call's place is the largest (position, call_id)
    among itself and all it waits for; ``wave`` counts, for calls with one place, the
    dependencies that point forward.  A call on a cycle, or after one, has no row.
    Dependencies on calls that the conversation does not have are ignored, repeated ones
    count once.  Ids must be unique and not null; an empty table gives no rows.  Rounds: the logarithm of a
    tangle's longest chain of calls with one open dependency each, and one more for each level at
    which calls with several meet in it; where there are cycles, the same for all that waits for them.
    """
    at = F.struct(F.col("position").alias("p"), F.col("call_id").alias("c"))
    own = calls.select("conv_id", "call_id", at.alias("at"))
    named = calls.select("conv_id", "call_id", at.alias("at"), F.explode(F.array_distinct("depends_on")).alias("dep"))
    edges = named.join(own.select("conv_id", F.col("call_id").alias("dep"), F.col("at").alias("dep_at")), ["conv_id", "dep"])
    edges = written(edges.select("conv_id", "call_id", "dep", F.when(F.col("dep_at") >= F.col("at"), F.col("dep_at")).alias("to")), "call-edges")
    reach = edges.where("to IS NOT NULL").groupBy("conv_id", "call_id").agg(F.max("to").alias("to"))
    tangled = _tangles(own.join(reach, ["conv_id", "call_id"], "left").withColumn("reach", F.coalesce("to", "at")).drop("to"))
    tangled = written(tangled, "call-tangles")
    forward = edges.where("to IS NOT NULL").join(tangled.select("conv_id", "call_id", "tangle"), ["conv_id", "call_id"]).groupBy("conv_id", "tangle").agg(F.count(F.lit(1)).alias("most"))
    place = F.struct("at", F.lit(0).cast("bigint").alias("wave")).alias("place")
    known = written(tangled.join(forward, ["conv_id", "tangle"], "left").select("conv_id", "call_id", "tangle", "most", place), "call-known")
    plain = known.where("most IS NULL").select("conv_id", "call_id", "place")
    # ``links``: the calls of its tangle that a call waits for, and how many forward dependencies lie on the way.
    inner = known.where("most IS NOT NULL").drop("place")
    deps = inner.select("conv_id", F.col("call_id").alias("dep"), F.col("tangle").alias("_tangle"))
    links = edges.join(inner.drop("most"), ["conv_id", "call_id"]).join(deps, ["conv_id", "dep"]).where("tangle = _tangle")
    links = links.groupBy("conv_id", "call_id").agg(F.collect_list(F.struct("dep", F.col("to").isNotNull().cast("bigint").alias("k"))).alias("links"))
    state = known.where("most IS NOT NULL").drop("tangle").join(links, ["conv_id", "call_id"], "left")
    empty = F.array().cast("array<struct<dep:string,k:bigint>>")
    state = state.select("conv_id", "call_id", "most", "place", F.coalesce("links", empty).alias("links"), F.lit(False).alias("bad"), F.lit(True).alias("moved"))
    found = _settled(state)
    out = plain.unionByName(found.where("NOT bad").select("conv_id", "call_id", "place"))
    # Where a call goes round, so do all behind it that wait for it.
    stuck = state.select("conv_id", "call_id").join(found.where("NOT bad").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    stuck = written(stuck.withColumn("stuck", F.lit(True)), "call-stuck")
    if stuck.limit(1).count():
        again = known.join(stuck.select("conv_id").distinct(), "conv_id", "left_semi").join(stuck, ["conv_id", "call_id"], "left")
        waits = edges.groupBy("conv_id", "call_id").agg(F.collect_list(F.struct("dep", F.lit(0).cast("bigint").alias("k"))).alias("links"))
        again = again.join(waits, ["conv_id", "call_id"], "left")
        bad = F.col("stuck").isNotNull()
        again = again.select("conv_id", "call_id", F.lit(1).cast("bigint").alias("most"), "place", F.when(bad | F.col("links").isNull(), empty).otherwise(F.col("links")).alias("links"), bad.alias("bad"), F.lit(True).alias("moved"))
        out = out.join(_settled(again).where("bad").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    return out.select("conv_id", "call_id", F.col("place.at.p").alias("after_position"), F.col("place.at.c").alias("after_call"), F.col("place.wave").cast("int").alias("wave"))


def _settled(state: DataFrame) -> DataFrame:
    """``conv_id, call_id, place, bad`` of calls ``conv_id, call_id, most, place, links, bad, moved`` after all that they wait for.

    ``links``: what a call waits for (dep), and how many forward dependencies lie on the way (k).
    ``bad`` calls have a cycle before them: those given as such, those that wait for one, and those with
    more than ``most`` forward dependencies on their way.  Calls that only wait for each other have no row.
    """
    paths = [stored(state, "call-places")]
    shape, spark = state.schema, state.sparkSession
    while True:
        state = spark.read.schema(shape).parquet(paths[-1])
        seen = state.agg(F.count_if(F.size("links") > 0).alias("open"), F.count_if("moved").alias("moved")).first()
        # Of all rounds, what waits for nothing more.
        settled = spark.read.schema(shape).parquet(*paths).where(F.size("links") == 0)
        if not seen["open"] or not seen["moved"]:
            return settled.select("conv_id", "call_id", "place", "bad")
        waiting = state.where(F.size("links") > 0)
        target = waiting.unionByName(settled).select(
            "conv_id", F.col("call_id").alias("dep"), F.col("place").alias("d"), F.size("links").alias("n"), F.get("links", F.lit(0)).alias("next"), F.col("bad").alias("_bad")
        )
        link = waiting.select("conv_id", "call_id", "most", "place", F.inline("links")).join(target, ["conv_id", "dep"])
        passed = F.when(F.col("n") < 2, F.struct(F.col("d.at").alias("at"), (F.col("d.wave") + F.col("k")).alias("wave")))
        ahead = F.when(F.col("n") == 1, F.struct(F.col("next.dep").alias("dep"), (F.col("k") + F.col("next.k")).alias("k"))).when(F.col("n") > 1, F.struct("dep", "k"))
        link = link.select("conv_id", "call_id", "most", "place", passed.alias("passed"), ahead.alias("ahead"), "_bad", (F.col("n") < 2).alias("_moved"))
        grown = link.groupBy("conv_id", "call_id").agg(
            F.first("most").alias("most"), F.greatest(F.first("place"), F.coalesce(F.max("passed"), F.first("place"))).alias("place"),
            F.array_sort(F.collect_list("ahead")).alias("links"),
            # More forward dependencies on the way than there are: the way goes round.
            (F.max("_bad") | F.coalesce(F.max(F.col("ahead.k") > F.col("most")), F.lit(False))).alias("bad"), F.max("_moved").alias("moved"),
        )
        last = lambda x, i: F.coalesce(F.get("links", i + 1)["dep"] != x["dep"], F.lit(True))
        paths.append(stored(grown.withColumn("links", F.when(F.col("bad"), F.slice("links", 1, 0)).otherwise(F.filter("links", last))), "call-places"))


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, Schema], messages: DataFrame | None = None) -> DataFrame:
    """One row per call, per result that answers none, and per message: ``conv_id, call_id, position, after_position, after_call, wave, status, errors, json``.

    ``calls``: conv_id, call_id, position, name, arguments (JSON), depends_on.  ``results``:
    conv_id, call_id, content.  ``messages``, of any other turns: conv_id, position, role, content.
    Status is ``invalid`` (errors in the arguments), else ``cyclic``, else ``unanswered``, else
    ``answered``; ``orphan`` for a result without a call, ``message`` for a message, and
    ``unlinked`` for a call or result whose conversation or call id is null: these never link, and
    each is a row of its own.  Of several results of a call the smallest content counts, and of
    repeated call ids the first and smallest call.  See ``ordered`` for the order.  Texts are
    carried whole, however long; null and empty ones differ in the JSON.  Other columns are not
    read; an empty table gives no rows.
    """
    identified = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    body = F.struct("position", "name", "arguments", "depends_on")
    own = calls.where(identified).groupBy("conv_id", "call_id").agg(F.min(body).alias("c"))
    own = written(own.select("conv_id", "call_id", "c.*"), "calls")
    answers = results.where(identified).groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.lit(True).alias("_answered"))
    linked = own.withColumn("_call", F.lit(True)).join(answers, ["conv_id", "call_id"], "full").join(ordered(own.select("conv_id", "call_id", "position", "depends_on")), ["conv_id", "call_id"], "left")
    errors = F.when(F.col("_call"), argument_errors("name", "arguments", tools)).otherwise(F.array().cast(NONE))
    status = (
        F.when(F.col("_call").isNull(), "orphan").when(F.size("errors") > 0, "invalid").when(F.col("wave").isNull(), "cyclic").when(F.col("_answered").isNull(), "unanswered").otherwise("answered")
    )
    out = linked.withColumn("errors", errors).withColumn("status", status).drop("_call", "_answered", "depends_on")
    # Rows that cannot link.
    loose = calls.where(~identified).select("conv_id", "call_id", "position", "name", "arguments", argument_errors("name", "arguments", tools).alias("errors"))
    loose = loose.unionByName(results.where(~identified).select("conv_id", "call_id", "content"), allowMissingColumns=True)
    out = out.unionByName(loose.withColumn("errors", F.coalesce("errors", F.array().cast(NONE))).withColumn("status", F.lit("unlinked")), allowMissingColumns=True)
    fields = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), "status")
    columns = ["conv_id", "call_id", "position", "after_position", "after_call", "wave", "status"]
    # The names of the fields are in order, and VARIANT objects keep theirs so.
    out = out.select(*columns, F.array_join("errors", ",").alias("errors"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))
    if messages is None:
        return out
    said = F.to_json(F.struct("content", "role"), {"ignoreNullFields": "false"})
    told = messages.select("conv_id", "position", F.col("position").alias("after_position"), F.lit(0).alias("wave"), F.lit("message").alias("status"), F.lit("").alias("errors"), said.alias("json"))
    return out.unionByName(told, allowMissingColumns=True)


#: The tools that op9 derives from user turns.
TOOLS = {
    "search": Schema("object", fields={"query": Schema("string", least=1), "limit": Schema("integer", least=1, most=5)}),
    "summarize": Schema("object", fields={
        "text": Schema("string"),
        "style": Schema("object", fields={"tone": Schema("string", one_of=('"plain"', '"formal"')), "parts": Schema("array", least=1, items=Schema("integer", most=4))}),
    }),
    "translate": Schema("object", fields={"text": Schema("string"), "to": Schema("string", pattern="^[a-z]{2}$"), "formal": Schema("boolean", required=False)}),
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tool calls from user turns, results from assistant turns and messages from all others of ``conv_id, turn, role, text``.

    A user's turn calls a tool chosen by the length of its text, with the whole text among
    its arguments.  By the conversation's id it depends on the turn two before it; or
    (1) on the one two after it; or (2) the third and fourth turns on each other, which
    is a cycle; or (3) the first turns on several later ones.  An assistant's turn answers
    the turn before it.
    """
    call_id = lambda t: F.concat(F.lit("call-"), F.lpad(t.cast("string"), 6, "0"))
    text, turn = F.coalesce(F.col("text"), F.lit("")), F.col("turn")
    n = F.length(text)
    pick = lambda c, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    name = pick(n, "search", "summarize", "translate")
    style = F.struct(F.array(n % 5, n % 7).alias("parts"), pick(n, "plain", "formal", "loud", None).alias("tone"))
    arguments = (
        F.when(n % 3 == 0, F.to_json(F.struct(text.alias("query"), (n % 7).alias("limit"))))
        .when(n % 3 == 1, F.to_json(F.struct(text.alias("text"), style.alias("style"))))
        .otherwise(F.to_json(F.struct(pick(n, None, "en", "EN", "fr").alias("to"), text.alias("text"), (n % 2 == 0).alias("formal"))))
    )
    on = lambda *steps: F.array(*[call_id(turn + s) for s in steps]).cast(NONE)
    kind, place = F.pmod("conv_id", F.lit(4)), F.floor(turn / 2)
    dep = (
        F.when(kind == 1, on(2))
        .when((kind == 2) & (place == 1), on(2))
        .when((kind == 3) & (place == 0), on(2, 4)).when((kind == 3) & (place == 1), on(2)).when((kind == 3) & (place == 2), on()).when(kind == 3, on(-2, -4))
        .otherwise(on(-2))
    )
    calls = conversations.where("role = 'user'").select("conv_id", call_id(turn).alias("call_id"), turn.alias("position"), name.alias("name"), arguments.alias("arguments"), dep.alias("depends_on"))
    results = conversations.where("role = 'assistant'").select("conv_id", call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    others = conversations.where("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", turn.alias("position"), "role", F.col("text").alias("content"))
    return calls, results, others


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = derived_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_calls(calls, results, TOOLS, others)


OP9_SQL = r"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, 'call-' || lpad(cast(turn AS VARCHAR), 6, '0') AS call_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, conv_id % 4 AS kind, turn // 2 AS place
  FROM conversations WHERE role = 'user'),
calls AS (
  SELECT *, ['search', 'summarize', 'translate'][n % 3 + 1] AS name,
         CASE n % 3 WHEN 0 THEN '{"limit":' || (n % 7) || ',"query":' || to_json(t) || '}'
                    WHEN 1 THEN '{"style":{"parts":[' || (n % 5) || ',' || (n % 7) || ']' || ['', '', ',"tone":"loud"', ''][n % 4 + 1] || CASE n % 4 WHEN 0 THEN ',"tone":"plain"' WHEN 1 THEN ',"tone":"formal"' ELSE '' END || '},"text":' || to_json(t) || '}'
                    ELSE '{"formal":' || (n % 2 = 0)::VARCHAR || ',"text":' || to_json(t) || CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN ',"to":"en"' WHEN 2 THEN ',"to":"EN"' ELSE ',"to":"fr"' END || '}' END AS arguments,
         array_to_string(list_sort(list_filter(CASE n % 3
           WHEN 0 THEN [CASE WHEN n = 0 THEN 'length:query' END, CASE WHEN n % 7 NOT BETWEEN 1 AND 5 THEN 'range:limit' END]
           WHEN 1 THEN [CASE n % 4 WHEN 2 THEN 'enum:style.tone' WHEN 3 THEN 'missing:style.tone' END, CASE WHEN n % 7 > 4 THEN 'range:style.parts[1]' END]
           ELSE [CASE n % 4 WHEN 0 THEN 'missing:to' WHEN 2 THEN 'pattern:to' END] END, lambda x: x IS NOT NULL)), ',') AS errors,
         CASE WHEN kind = 1 OR kind = 2 AND place = 1 OR kind = 3 AND place = 1 THEN [turn + 2] WHEN kind = 3 AND place = 0 THEN [turn + 2, turn + 4]
              WHEN kind = 3 AND place = 2 THEN [] WHEN kind = 3 THEN [turn - 2, turn - 4] ELSE [turn - 2] END AS deps
  FROM u),
e AS (SELECT c.conv_id, c.turn AS a, d.turn AS b, cast(d.turn >= c.turn AS INT) AS f FROM (SELECT conv_id, turn, unnest(deps) AS dep FROM calls) c JOIN calls d ON d.conv_id = c.conv_id AND d.turn = c.dep),
reach AS (SELECT conv_id, a, b FROM e UNION SELECT r.conv_id, r.a, e.b FROM reach r JOIN e ON e.conv_id = r.conv_id AND e.a = r.b),
loops AS (SELECT conv_id, a FROM reach WHERE a = b),
stuck AS (SELECT conv_id, a FROM loops UNION SELECT r.conv_id, r.a FROM reach r JOIN loops l ON l.conv_id = r.conv_id AND l.a = r.b),
walk AS (
  SELECT conv_id, turn AS a, turn AS b, 0 AS k FROM calls c WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.conv_id = c.conv_id AND s.a = c.turn)
  UNION SELECT w.conv_id, w.a, e.b, w.k + e.f FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.a = w.b),
lv AS (SELECT conv_id, a AS turn, max(struct_pack(b := b, k := k)) AS v FROM walk GROUP BY conv_id, a),
res AS (SELECT conv_id, 'call-' || lpad(cast(turn - 1 AS VARCHAR), 6, '0') AS call_id, min(text) AS content, true AS answered FROM conversations WHERE role = 'assistant' GROUP BY ALL),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS position, lv.v.b AS after_position, 'call-' || lpad(cast(lv.v.b AS VARCHAR), 6, '0') AS after_call, lv.v.k AS wave,
         coalesce(c.errors, '') AS errors, c.name, c.arguments, r.content,
         CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN c.errors <> '' THEN 'invalid' WHEN lv.v IS NULL THEN 'cyclic' WHEN r.answered IS NULL THEN 'unanswered' ELSE 'answered' END AS status
  FROM calls c FULL JOIN res r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn)
SELECT conv_id, call_id, position, after_position, after_call, wave, status, errors,
       '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
       || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS json
FROM j
UNION ALL
SELECT conv_id, NULL, turn, turn, NULL, 0, 'message', '', '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
