"""Sources: stored logs by generation, compressed frames, key-value units, envelopes, manifests, files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_NAME = r"^session(?:\.v([1-9][0-9]*))?\.jsonl$"
EVENT = "type string, seq bigint, time bigint, data string"


def log_generation(name: Column) -> Column:
    """The generation of a log's file name: 0 without one, null for any other file."""
    return F.when(name.rlike(LOG_NAME), F.coalesce(F.nullif(F.regexp_extract(name, LOG_NAME, 1), F.lit("")).cast("int"), F.lit(0)))


def newest_generation(files: DataFrame) -> DataFrame:
    """(session_id, name, generation): of (session_id, name) the log of the greatest generation."""
    g = files.withColumn("generation", log_generation(F.col("name"))).where("generation is not null")
    return g.groupBy("session_id").agg(F.max_by("name", "generation").alias("name"), F.max("generation").alias("generation"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, generation, type, seq, time, data, corrupt) of ``path/<session>/session*.jsonl``, newest generation each."""
    raw = spark.read.schema(EVENT + ", corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("recursiveFileLookup", "true").json(path)
    at = F.split(F.col("_metadata.file_path"), "/")
    rows = raw.select("*", F.element_at(at, -2).alias("session_id"), log_generation(F.element_at(at, -1)).alias("generation")).where("generation is not null")
    newest = rows.groupBy("session_id").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["session_id", "generation"], "left_semi").select("session_id", "generation", "type", "seq", "time", "data", "corrupt")


def frame_ends(data: bytes, most: int | None = None) -> tuple[list[int], int]:
    """(ends of whole Zstandard frames, where the first incomplete one starts), by the format's headers alone."""
    ends, at = [], 0
    while at < len(data) and (most is None or len(ends) < most):
        end = _frame_end(data, at)
        if end is None:
            break
        ends.append(end)
        at = end
    return ends, at


def _frame_end(data: bytes, at: int) -> int | None:
    if len(data) < at + 4:
        return None
    (magic,) = struct.unpack_from("<I", data, at)
    if 0x184D2A50 <= magic <= 0x184D2A5F:  # a skippable frame says its size
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0] if len(data) >= at + 8 else None
        return end if end is not None and end <= len(data) else None
    if magic != 0xFD2FB528:
        raise ValueError(f"no frame at byte {at}")
    if len(data) < at + 5:
        return None
    head = data[at + 4]
    single = head >> 5 & 1
    size = (0 if single else 1) + (0, 1, 2, 4)[head & 3] + (single, 2, 4, 8)[head >> 6]
    here = at + 5 + size
    while len(data) >= here + 3:
        block = int.from_bytes(data[here : here + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError(f"reserved block at byte {here}")
        here += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            here += 4 * (head >> 2 & 1)
            return here if here <= len(data) else None
    return None


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, line, text, torn_at) of files of Zstandard frames; what a torn end holds is left out and told."""
    import zstandard

    def run(frames):
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                ends, torn = frame_ends(data)
                at = 0
                for k, end in enumerate(ends):
                    text = zstandard.ZstdDecompressor().decompressobj().decompress(data[at:end]).decode("utf-8", "replace")
                    out += [(name, k, n, line, torn if torn < len(data) else None) for n, line in enumerate(text.splitlines())]
                    at = end
            yield pd.DataFrame(out, columns=["path", "frame", "line", "text", "torn_at"]).astype({"torn_at": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame int, line int, text string, torn_at bigint")


def read_unit(rows: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The declared tables of a key-value unit (tbl, key, value): (key, record, bad); a value that is no such record is bad."""
    out = {}
    for name, schema in schemas.items():
        record = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        part = rows.where(F.col("tbl") == name).select("key", record.alias("record"))
        out[name] = part.select("key", "record", (F.col("record").isNull() | F.col("record._bad").isNotNull()).alias("bad"))
    return out


def quarantined(records: DataFrame, derived: bool) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows with ``bad``: derived data goes on without them; a bad record of record is a ValueError."""
    good, bad = records.where("NOT bad"), records.where("bad")
    if not derived and not bad.isEmpty():
        raise ValueError("an authoritative domain holds a bad record")
    return good, bad


def read_envelopes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(name, …) of every ``*.json`` of a folder, keyed by base name; other files are passed over."""
    raw = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return raw.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "").alias("name"), "*")


def by_manifest(manifest: DataFrame, gold: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, outcome): no_gold where the gold cannot be read, missing_output, or ready; rows of the manifest alone decide."""
    g = gold.select(key, F.col("corrupt").isNull().alias("readable"))
    o = outputs.select(key, F.lit(True).alias("there")).distinct()
    out = manifest.select(key).join(g, key, "left").join(o, key, "left")
    return out.select(key, F.when(~F.coalesce("readable", F.lit(False)), "no_gold").when(F.col("there").isNull(), "missing_output").otherwise("ready").alias("outcome"))


def mirrored(spark: SparkSession, root: str, path: str, mirror: str) -> str:
    """``path`` below the root, or below the mirror where it is not there; the session's own file systems look."""
    jvm = spark._jvm

    def there(p: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    first, second = f"{root}/{path}", f"{root}/{mirror}/{path}"
    return first if there(first) or not there(second) else second


def by_revision(cache: str, path: str, revision: str) -> str:
    """Where the copy of a file of one revision stands: another revision has another place."""
    import hashlib

    return f"{cache}/{hashlib.sha256(f'{revision}:{path}'.encode()).hexdigest()[:16]}/{path}"


def search_files(spark: SparkSession, path: str, pattern: str, most: int, line_bytes: int = 2000, glob: str | None = None) -> tuple[DataFrame, bool]:
    """(path, line) that match, ``most`` at most and cut to ``line_bytes``, and whether there are more."""
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    hits = lines.where(F.col("value").rlike(pattern)).select(F.col("_metadata.file_path").alias("path"), F.left("value", F.lit(line_bytes)).alias("line"))
    some = hits.orderBy("path", "line").limit(most + 1)
    return some.limit(most), some.count() > most


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``blocks``: (kind, text) of headings, paragraphs and list items in page order, markup and entities gone."""
    block = r"(?is)<(h[1-6]|p|li|td|th)\b[^>]*>(.*?)</\1\s*>"
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(block), 0)
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(bare(x), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return pages.withColumn("blocks", F.filter(F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, r"(?i)^<([a-z]+[1-6]?)", 1)).alias("kind"), plain(x).alias("text"))), lambda b: b["text"] != ""))


def paged(pages: DataFrame, wanted: int, include: list[str], exclude: list[str], most_pages: int = 8) -> DataFrame:
    """(url, title, page) of result pages (page, pos, url, title): the first ``wanted`` different addresses whose title fits."""
    from pyspark.sql.window import Window

    from loomlake.operators.filters import title_terms

    fit = pages.where((F.col("page") <= most_pages) & title_terms(F.col("title"), include, exclude))
    first = fit.withColumn("rn", F.row_number().over(Window.partitionBy("url").orderBy("page", "pos"))).where("rn = 1")
    return first.orderBy("page", "pos").limit(wanted).select("url", "title", "page")
