"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_contamination
from .html import main_text
from .jaccard import jaccard_components
from .licenses import scan_licenses
from .maxent import lm_scores
from .mixing import mix_sources, share_out
from .quality import BASE, quality_rules
from .sharding import shard_rows
from .suffix_dedup import remove_repeats
from .token_files import read_index, write_tokens
from .util import shared_dir
from .sql import LICENSES_SQL, QUALITY_SQL

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 8
#: Weights of the sources in their order, repeating; the budget and the most of a source, in its sizes.
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/loomlake/{uuid.uuid4().hex}/tokens"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(spark, path).withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), out_col="q")
    base = F.exists("q.failed", lambda r: r.isin(*BASE))
    return q.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", base.alias("base_failed"), "q.kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated", "longest")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7
    docs = docs.withColumn("held_out", rest == 2)
    scored = lm_scores(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license_digest", "license_id", F.array_join("notice_ids", ",").alias("notices"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def source_quotas(totals: dict[tuple, int]) -> dict:
    """Targets of the sources, in the order of code points with null last."""
    sizes: dict = {}
    for pattern, words in totals.items():
        for s in dict.fromkeys(pattern):
            sizes[s] = sizes.get(s, 0) + words
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    return share_out({s: sizes[s] for s in order}, weights, BUDGET * sum(totals.values()), MOST)


def mixed_documents(docs: DataFrame, copies_col: str = "copies", taken_col: str = "taken") -> tuple[DataFrame, dict, dict]:
    """The mixture of documents, and sizes and targets of the sources."""
    seen: dict = {}

    def quotas(totals: dict[tuple, int]) -> dict:
        seen["sizes"] = {p[0]: n for p, n in totals.items() if p}
        seen["targets"] = source_quotas(totals)
        return seen["targets"]

    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    mixed, _ = mix_sources(docs, F.array("source"), size, quotas, repeats=MOST, copies_col=copies_col, taken_col=taken_col)
    return mixed, seen["sizes"], seen["targets"]


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed, sizes, targets = mixed_documents(docs)

    def of(values: dict, kind: str):
        out = F.lit(None).cast(kind)
        for s, v in values.items():
            out = F.when(F.col("source").eqNullSafe(F.lit(s).cast("string")), F.lit(v).cast(kind)).otherwise(out)
        return out

    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return mixed.select("doc_id", size.alias("size"), of(sizes, "long").alias("source_size"), of(targets, "double").alias("target"), "taken", "copies")


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_token_coder": op2_token_coder,
        "op3_quality_rules": op3_quality_rules,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_decontamination": op5_decontamination,
        "op7_lm_scores": op7_lm_scores,
        "op8_html_extraction": op8_html_extraction,
        "op6_license_scan": op6_license_scan,
        "op9_mixing": op9_mixing,
        "op10_ngram_jaccard": op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": QUALITY_SQL, "op6_license_scan": LICENSES_SQL()}
