"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the last return the
columns of ``documents``; texts carry the cuts of earlier stages, and ``n_chars`` follows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import decontaminate, line_dedup, ngram_join, packing, quality
from skyfold.llm.common import free_name, table
from skyfold.llm.queries import tokenizer_files
from skyfold.session import stored


def _with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and documents that the rules reject go."""
    name = free_name(docs, "quality")
    return _with_text(quality.assess(docs, output=name).filter(f"{name}.kept"), docs.columns, F.col(f"{name}.clean_text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go, and documents that consist of nothing else."""
    name = free_name(docs, "line_dedup")
    out = line_dedup.remove_repeats(docs, output=name).filter(f"{name}.n_removed < {name}.n_lines")
    return _with_text(out, docs.columns, F.col(f"{name}.kept_text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays; equal rows count once."""
    gone = ngram_join.join_components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go; documents of which they are more than half go whole."""
    name = free_name(docs, "decontam")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), output=name)
    return _with_text(out.filter(f"2 * {name}.n_hit <= {name}.n_words"), docs.columns, F.col(f"{name}.clean_text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their sequence and place."""
    packed = packing.pack(docs, *tokenizer_files())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_stage),
          ("decontaminate", benchmark_stage), ("best_fit_packing", packing_stage)]

# Tokens, the near-duplicate components and the choice of sequences are beyond SQL; tests hold run() against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
