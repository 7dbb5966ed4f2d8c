"""Sinks: appended logs, upserted records with a change feed, shipped ranges, reports and exports.

Parquet below one folder; Spark's committer makes each write appear whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class SequenceError(ValueError):
    """A batch that does not go on where the stored log ends."""


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_batch(events: DataFrame, path: str) -> int:
    """Appends events (session_id, seq, …) and returns how many; stored rows are never rewritten.

    Each session's batch must be dense and begin where its stored log ends, else SequenceError and
    nothing is written. Returning means that the batch is committed.
    """
    spark = events.sparkSession
    ends = _stored(spark, path, events.schema).groupBy("session_id").agg((F.max("seq") + 1).alias("next"))
    own = events.groupBy("session_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("d"))
    wrong = own.join(ends, "session_id", "left").where((F.col("lo") != F.coalesce("next", F.lit(0))) | (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("n") != F.col("d")))
    if bad := wrong.limit(1).collect():
        raise SequenceError(f"session {bad[0]['session_id']}: batch begins at {bad[0]['lo']}, expected {bad[0]['next'] or 0}")
    events.write.mode("append").parquet(path)
    return own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def put_records(changes: DataFrame, path: str) -> None:
    """Appends changes (tbl, key, value, version); a null value deletes. Deleting twice is no error."""
    changes.select("tbl", "key", "value", "version").write.mode("append").parquet(path)


def latest_records(changes: DataFrame) -> DataFrame:
    """(tbl, key, value, version): the last change of each key, deleted ones left out."""
    rn = F.row_number().over(Window.partitionBy("tbl", "key").orderBy(F.desc("version")))
    return changes.withColumn("rn", rn).where("rn = 1 and value is not null").drop("rn")


def change_feed(changes: DataFrame) -> DataFrame:
    """(tbl, key, version, op, value): put or delete with the new value, never the old; deletes of nothing are left out."""
    before = F.lag("value").over(Window.partitionBy("tbl", "key").orderBy("version"))
    rows = changes.withColumn("before", before).where("value is not null or before is not null")
    return rows.select("tbl", "key", "version", F.when(F.col("value").isNull(), "delete").otherwise("put").alias("op"), "value")


def shipped(events: DataFrame, progress: DataFrame) -> DataFrame:
    """Events behind each session's accepted seq and up to its ``through``; a session without progress ships from 0."""
    return events.join(progress, "session_id").where((F.col("seq") > F.coalesce("accepted", F.lit(-1))) & (F.col("seq") <= F.col("through"))).select(*events.columns)


def accepted_seq(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, accepted, invalid): the highest accepted seq by delivery events of the session's format.

    An event that accepts itself or what comes later, or names another session, is invalid.
    """
    rows = events.join(sessions.select("session_id", "version"), "session_id").where(F.coalesce("format", F.lit(0)) == F.col("version"))
    bad = (F.col("through_seq") >= F.col("seq")) | (F.col("through_seq") < 0) | (F.col("names") != F.col("session_id"))
    return rows.groupBy("session_id").agg(F.max(F.when(~bad, F.col("through_seq"))).alias("accepted"), F.count_if(bad).alias("invalid"))


def comparison_report(differences: DataFrame, most: int) -> DataFrame:
    """(kind, n, first): how many differences of each kind (kind, item), and the first ``most`` of them."""
    rn = F.row_number().over(Window.partitionBy("kind").orderBy("item"))
    return differences.withColumn("rn", rn).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.col("item")))).alias("first"))


def report_bundle(groups: DataFrame, cases: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(group_id, members, missing, ok): report groups (group_id, members) with their cases and envelopes.

    A group is ok if every member is a case of the list and has an envelope of the run it names.
    """
    parts = groups.select("group_id", F.explode("members").alias("case_id")).join(cases, "case_id", "left").join(envelopes, "case_id", "left")
    good = F.col("listed_run").isNotNull() & F.col("listed_run").eqNullSafe(F.col("run_id"))
    return parts.groupBy("group_id").agg(F.array_sort(F.collect_list("case_id")).alias("members"), F.array_sort(F.collect_list(F.when(~good, F.col("case_id")))).alias("missing"), F.bool_and(good).alias("ok"))


def export_logs(events: DataFrame, wanted: DataFrame, lineage: DataFrame, path: str, descendants: bool = True) -> None:
    """The logs of the wanted sessions (id), and of all below them where asked, in a folder for each session."""
    ids = wanted.select("id")
    if descendants:
        ids = ids.unionByName(lineage.join(wanted.select(F.col("id").alias("root")), "root", "left_semi").select("id")).distinct()
    events.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_semi").repartition("session_id").sortWithinPartitions("session_id", "seq").write.mode("errorifexists").partitionBy("session_id").parquet(path)


def telemetry(records: DataFrame) -> DataFrame:
    """(channel, time, severity, attributes, body): records as a sink takes them; null attributes are left out."""
    return records.select("channel", "time", F.coalesce("severity", F.lit("info")).alias("severity"), F.map_filter("attributes", lambda k, v: v.isNotNull()).alias("attributes"), F.coalesce("body", F.lit("")).alias("body"))
