"""Line dedup by distinct-site spread.

Every line's sites go into a HyperLogLog sketch under the line's hash; sketches
merge by aggregation, so a line on every page costs no task more than its share.
A line whose estimate is clearly above the threshold is boilerplate; one near the
threshold gets an exact distinct count.  Boilerplate stays where it first stands
and is removed everywhere else.  Which documents lose a line is known by id first; a
bitmap of their hashes lets all other texts stay where they are.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.hot import looked_up
from reelspan.llm.names import columns, fresh, quoted
from reelspan.llm.scratch import written

MIN_SITES = 5
LOG_K = 12
#: Estimates within this share of the threshold (four standard errors), or within 1, are counted exactly.
NEAR = 4 * 1.04 / (1 << (LOG_K // 2))
#: What is cut from both ends of a line before lines are compared.
EDGE = " \t\r"


#: Bits of the bitmap for each document that loses a line, at most so many bits in all (64 MB), and in one row of it.
KEY_BITS, MOST_BITS, ROW_BITS = 16, 1 << 29, 1 << 15


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h1, h2, first, n`` of lines on at least ``min_sites`` distinct sites, from rows ``h1, h2, site, id, pos``.

    A null site is no site.  ``first`` is the smallest (id, pos), null ids last; ``n`` is how often the line stands.
    """
    at = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("pos").alias("pos"))
    band = max(1.0, NEAR * min_sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"), F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    spread = written(spread.where(F.col("sites") >= min_sites - band), "line-spread")
    sure = spread.where(F.col("sites") > min_sites + band)
    near = spread.where(F.col("sites") <= min_sites + band)
    exact = (
        looked_up(lines.where(F.col("site").isNotNull()).select("h1", "h2", "site"), near.select("h1", "h2", "n"), ["h1", "h2"], "n", lines.count())
        .distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_exact")).where(F.col("_exact") >= min_sites)
    )
    return sure.drop("sites").unionByName(near.drop("sites").join(exact.drop("_exact"), ["h1", "h2"]))


def maybe_in(rows: DataFrame, keys: DataFrame, n: int, key: Column, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false if the bigint ``key`` is certainly not among the ``n`` of ``keys`` (column ``key``)."""
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (KEY_BITS * n).bit_length()))
    part, bit, bitmap = fresh(rows, "part", "bit", "bitmap")
    place = lambda k: F.pmod(k, F.lit(bits))
    own = keys.select(F.floor(place(F.col("key")) / ROW_BITS).alias(part), (place(F.col("key")) % ROW_BITS).alias(bit))
    bitmaps = own.groupBy(part).agg(F.bitmap_construct_agg(bit).alias(bitmap))  # at most MOST_BITS / 8 bytes
    found = rows.withColumn(part, F.floor(place(key) / ROW_BITS)).withColumn(bit, place(key) % ROW_BITS).join(F.broadcast(bitmaps), part, "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(F.col(bit) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    test = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(`{bit}` % 8 AS INT))")) != 0, F.lit(False))
    return found.withColumn(name, test).drop(part, bit, bitmap)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", id_col: str = "doc_id", site: str = "source", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the columns ``n_lines`` and ``n_removed`` (``names``).

    Lines are what line feeds separate; they are compared without spaces, tabs and
    carriage returns at their ends, and blank ones are left alone.  A line that
    stands on ``min_sites`` or more distinct sites is kept at its smallest (id,
    place) and removed elsewhere.  A null site is no site; a null text stays null
    with no lines; rows that repeat an id and a text lose the same lines; very long texts are
    read whole.  An empty table gives no rows.  Columns of these names in ``docs`` are
    replaced, however they are spelled; others are kept, whatever their names.
    """
    rows = docs.select(*columns([c for c in docs.columns if c.lower() not in [n.lower() for n in names]]))
    body, own_id = F.col(quoted(text)), F.col(quoted(id_col))
    line = F.btrim(F.col("_line"), F.lit(EDGE))
    lines = written(
        rows.select(own_id.alias("id"), F.col(quoted(site)).alias("site"), F.xxhash64(body).alias("th"), F.posexplode(F.split(body, "\n")).alias("pos", "_line"))
        .select("id", "site", "th", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), (line != "").alias("_full"))
        .where("_full").drop("_full"),
        "lines",
    )
    known = written(boilerplate(lines, min_sites), "line-boilerplate")
    elsewhere = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos")))
    gone = looked_up(lines.select("id", "th", "pos", "h1", "h2"), known, ["h1", "h2"], "n", lines.count()).where(elsewhere)
    gone = written(gone.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "line-gone")

    th, maybe, loses = fresh(rows, "th", "maybe", "gone")
    hashed = maybe_in(rows.withColumn(th, F.xxhash64(body)), gone.select(F.xxhash64("id", "th").alias("key")), gone.count(), F.xxhash64(own_id, F.col(th)), maybe)
    plain = hashed.where(~F.col(maybe)).withColumn(loses, F.lit(None).cast("array<int>"))
    g = gone.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("gone").alias("_gone"))
    same = F.col(f"d.{quoted(id_col)}").eqNullSafe(F.col("g._id")) & (F.col(f"d.{quoted(th)}") == F.col("g._th"))
    moved = hashed.where(F.col(maybe)).alias("d").join(g.hint("shuffle_hash").alias("g"), same, "left")
    found = plain.unionByName(moved.select(*columns(hashed.columns, "d"), F.col("g._gone").alias(loses)))
    lost, split = F.col(loses), F.split(body, "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains(lost, i)), "\n")
    cleaned = F.when(lost.isNull(), body).otherwise(kept)
    return found.select(
        *[cleaned.alias(c) if c == text else F.col(quoted(c)) for c in rows.columns],
        F.when(body.isNull(), F.lit(0)).otherwise(F.size(split)).cast("bigint").alias(names[0]),
        F.when(lost.isNull(), F.lit(0)).otherwise(F.size(lost)).cast("bigint").alias(names[1]),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS k
  FROM (SELECT doc_id, source, unnest(s) AS line, unnest(range(len(s))) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents))),
b AS (
  SELECT k, min(struct_pack(d := doc_id, p := pos)) AS f FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 5),
m AS (
  SELECT l.*, b.k IS NOT NULL AND NOT (b.f.d = l.doc_id AND b.f.p = l.pos) AS gone FROM l LEFT JOIN b ON l.k = b.k),
t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
