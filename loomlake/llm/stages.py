"""The stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that are kept.

Each stage keeps all columns of its input, whatever their names: where an operator would give a column
of the same name, the input's steps aside and comes back. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import OUT, find_contamination
from .jaccard import jaccard_components
from .mixing import repeated
from .quality import quality_rules
from .queries import SHARDS, mixed_documents
from .sharding import shard_rows
from .util import col, fresh, row_hash


def _aside(docs: DataFrame, outs: tuple[str, ...]) -> tuple[DataFrame, Callable[[], list[Column]]]:
    """``docs`` with the columns named like ``outs`` renamed, and what selects its columns as they were."""
    clash = [c for c in docs.columns if c.lower() in outs]
    names = dict(zip(clash, fresh(docs, *clash), strict=True))
    renamed = docs.select(*[col(c).alias(names.get(c, c)) for c in docs.columns])
    return renamed, lambda: [col(names.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule. A null text has no words and fails; equal rows share their verdict."""
    (q,) = fresh(docs, "quality")
    return quality_rules(docs, out_col=q).where(F.col(f"{q}.kept")).select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, null last, then of the least row hash.

    Groups are told apart by their component, so null ids and ids that repeat in different groups
    lose nothing. Documents without words are in no group and stay, equal rows of them once.
    """
    renamed, back = _aside(docs, ("component_id", "n_shingles"))
    root, row, chosen = fresh(renamed, "root", "row", "chosen")
    found = jaccard_components(renamed, root_col=root).withColumn(row, row_hash(renamed, 3))
    least = found.where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    whole = F.struct(*[col(c) for c in renamed.columns])
    kept = least.groupBy(F.col(root), F.when(F.col(root).isNull(), F.col(row))).agg(F.min_by(whole, F.col(row)).alias(chosen))
    return kept.select(f"{chosen}.*").select(*back())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim passage of the benchmark. Null texts hold none; without items all stay."""
    renamed, back = _aside(docs, OUT)
    found = find_contamination(renamed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*back())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to target weights; a document that is taken twice stands there twice.

    A null source is a source, a null or blank text a document of no words, which stays once; equal
    rows are taken alike.
    """
    copies, taken = fresh(docs, "copies", "taken")
    return repeated(mixed_documents(docs, copies, taken)[0], copies, taken)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot, under names of their own where the rows have such columns."""
    taken = {c.lower() for c in docs.columns}
    names = [n if n not in taken else fresh(docs, n)[0] for n in ("shard", "slot")]
    return shard_rows(docs, SHARDS, shard_col=names[0], slot_col=names[1])
