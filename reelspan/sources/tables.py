"""Reading and writing the tables: Parquet, JSON and JDBC."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators.transcript import replaced
from reelspan.schemas import schema

#: Rows in one insert.
JDBC_BATCH = 500


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A whole entity table from ``root/name.parquet`` with its declared columns."""
    return spark.read.schema(schema(name)).parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, lower=None, upper=None, partitions: int = 1, **options: str) -> DataFrame:
    """A table from a database; with ``column`` and bounds in so many partitions."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def read_answers(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Recognizer answers, one JSON object a line with clip_id, chunk_idx and the answer's own fields in ``response``.

    ``form``: phrase_response (parallel arrays) or word_response (records).
    """
    raw = spark.read.schema(f"clip_id string, chunk_idx bigint, response {schema(form).simpleString()}").json(path)
    return raw.where(F.col("clip_id").isNotNull())


def transcript_id(video_id: str, run_id: str) -> Column:
    """An id that is the same each time a run is repeated."""
    return F.sha2(F.concat_ws("|", F.col(video_id).cast("string"), F.lit(run_id)), 256)


def append_transcripts(words: DataFrame, path: str, run_id: str, key: str = "transcript_id") -> None:
    """Rows added to the table at ``path`` as the folder of a run, once.

    A run that is repeated, after a failure or not, replaces what it wrote; keys that another run has written
    are not added again.  Readers see a run's rows when its folder is committed.
    """
    spark = words.sparkSession
    if _exists(spark, path):
        other = spark.read.schema(f"`{key}` {words.schema[key].dataType.simpleString()}, run string").parquet(path).where(F.col("run") != run_id)
        words = words.join(other.select(key).distinct(), key, "left_anti")
    words.withColumn("run", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _execute(spark: SparkSession, url: str, statement: str) -> None:
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.createStatement().executeUpdate(statement)
    finally:
        connection.close()


def append_jdbc(words: DataFrame, url: str, name: str, run_id: str, key: str = "transcript_id", **options: str) -> None:
    """Rows added to a database table, once: to a table of the run first, and from there in one statement those whose key is not there yet.

    A run that fails leaves the table as it was; one that is repeated adds nothing.  ``run_id`` is part of a table's name.
    """
    spark = words.sparkSession
    into = lambda df, table, mode: df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", JDBC_BATCH).options(**options).mode(mode).save()
    stage = f"{name}_stage_{run_id}"
    into(words.limit(0), name, "append")  # there is a table
    into(words, stage, "overwrite")
    listed = ", ".join(f'"{c}"' for c in words.columns)
    # Some databases hold Spark's strings as large objects, which they do not compare.
    same = " = ".join(f'CAST({t}."{key}" AS VARCHAR(1000))' for t in "ts")
    _execute(spark, url, f'INSERT INTO {name} ({listed}) SELECT {listed} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {name} t WHERE {same})')
    _execute(spark, url, f"DROP TABLE {stage}")


def replace_transcripts(spark: SparkSession, path: str, new: DataFrame, out: str, key: str = "video_id") -> None:
    """The table at ``path`` with the keys of ``new`` replaced, written to ``out``."""
    old = spark.read.parquet(path)
    replaced(old.drop(*[c for c in old.columns if c not in new.columns]), new, key).write.mode("overwrite").parquet(out)


#: Rows of a bucket, about: of the bucketed table, and of the folders of ``overwrite_keys``.
BUCKET_ROWS = 2_000_000
MOST_BUCKETS = 20_000


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return min(MOST_BUCKETS, max(1, -(-rows // bucket_rows)))


def save_bucketed(rows: DataFrame, name: str, path: str, key: str = "video_id", bucket_rows: int = BUCKET_ROWS) -> int:
    """``rows`` as a table of the session's catalog at ``path``, in as many buckets of ``key`` as the rows ask for: how many."""
    n = buckets_for(rows.count(), bucket_rows)
    rows.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return n


def declare_bucketed(spark: SparkSession, name: str, path: str, schema_ddl: str, buckets: int, key: str = "video_id") -> None:
    """A table that another session saved: the catalog in memory does not outlive a session, the files do."""
    spark.sql(f"CREATE TABLE {name} ({schema_ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")


def buckets_of(spark: SparkSession, name: str) -> int:
    return int(next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Num Buckets"))


def kept_rows(spark: SparkSession, name: str, new: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of a bucketed table whose key ``new`` does not have: the new keys are dealt out by bucket, the table's rows stay where they are."""
    old = spark.table(name)
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns)


def replace_bucketed(spark: SparkSession, name: str, new: DataFrame, path: str, key: str = "video_id") -> None:
    """The keys of ``new`` replaced in a bucketed table, whose files are at ``path`` from then on.

    The next table is written beside the old one and takes its name when it is complete; until then readers
    have the old one.  Only ``new`` is shuffled.  The old files stay where they were.
    """
    n, following = buckets_of(spark, name), f"{name}_next"
    spark.sql(f"DROP TABLE IF EXISTS {following}")
    kept_rows(spark, name, new, key).write.mode("overwrite").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(following)
    rows = new.select(*spark.table(following).columns).repartition(n, key)
    rows.write.mode("append").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(following)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {following} RENAME TO {name}")


def overwrite_keys(new: DataFrame, path: str, key: str = "video_id", bucket_rows: int = BUCKET_ROWS) -> None:
    """The rows of ``new``'s keys are replaced in the table at ``path``, which lies in folders by hash of the key.

    The number of folders follows the rows of the first write.  Only the folders that hold such a key are
    written again; their other rows are set aside in a folder beside the table first, where they stay until the next time.
    """
    spark = new.sparkSession
    aside = f"{path.rstrip('/')}-kept"
    known = spark.read.parquet(path).select("of").first() if _exists(spark, path) else None
    buckets = known["of"] if known else buckets_for(new.count(), bucket_rows)
    rows = new.withColumn("of", F.lit(buckets)).withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    if known:
        old = spark.read.schema(rows.schema).parquet(path)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most MOST_BUCKETS
        old.where(F.col("bucket").isin(touched)).join(new.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(aside)
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(aside))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(path)


#: Folders of our own for a local master, by application, and what ``shared_folder`` has given out.
_local: dict[str, str] = {}
_given: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; for a local master without the setting, under a local one, the same each time."""
    folder, own = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if own not in _local:
            _local[own] = tempfile.mkdtemp(prefix="spark-tables-")
        folder = _local[own]
    _given.setdefault(own, []).append(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _given[own][-1]


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a ``shared_folder`` and read again: for what a query reads more than once."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def clear_folders(spark: SparkSession) -> None:
    """Removes what is in all folders that ``shared_folder`` has given out; results that still read them are then lost."""
    for folder in _given.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_specs(specs_json: DataFrame, path: str) -> None:
    """One JSON object a line, compressed: names of fields are most of it."""
    specs_json.select(F.col("json").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_scripts(script_lines: DataFrame, path: str, key: str = "clip_id") -> None:
    """Caption scripts as Parquet with columns key, n and line, sorted by key and place: no file or folder for each clip."""
    script_lines.select(key, "n", "line").repartitionByRange(key, "n").sortWithinPartitions(key, "n").write.mode("overwrite").parquet(path)


def read_script(spark: SparkSession, path: str, clip: str | int, key: str = "clip_id") -> DataFrame:
    """The lines of one clip's script in order; files of other keys are not read."""
    return spark.read.parquet(path).where(F.col(key) == clip).orderBy("n").select("line")
