"""What the operators of this subpackage share: names, folders, whole-row hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and RE2 pattern of what stands between words.
GAP = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate = "_" + candidate
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary one is made and set, as in tests, but only for a local master: on
    a cluster no machine's own folder will do, and it is a RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomlake/{uuid.uuid4().hex}/{what}"
    df.write.option("compression", "zstd").parquet(path)
    return located(spark.read.schema(df.schema).parquet(path), path)


def located(df: DataFrame, path: str | None) -> DataFrame:
    """``df`` with a note of the written table that it reads."""
    df._loomlake_path = path
    return df


def discard(*frames: DataFrame) -> None:
    """Deletes the tables behind frames of ``written``, once all that reads them has been written.

    The files of shuffles that nothing refers to go too: Spark's cleaner waits for the driver's next
    collection, which a job of many written tables must not leave to chance.
    """
    spark = frames[0].sparkSession
    jvm = spark._jvm
    for frame in frames:
        if path := getattr(frame, "_loomlake_path", None):
            at = jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.java.lang.System.gc()


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return False


def row_hash(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of the whole row; equal rows have equal hashes."""
    parts = [F.to_json(F.struct(col(f.name))) if _has_map(f.dataType) else col(f.name) for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *parts)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers as a literal of the plan."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in fields) + " WHERE false")

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (list, tuple)):
            return "array(" + ", ".join(lit(y) for y in x) + ")" if x else "CAST(array() AS array<bigint>)"
        return f"({x}L)" if x != -(2**63) else "(-9223372036854775807L - 1L)"

    values = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
