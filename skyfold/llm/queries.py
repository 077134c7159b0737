"""The registered queries of the numbered operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import (chat, decontaminate, html_layout, line_dedup, ngram_join, packing, quality, secret_scan, sharding, spelling, substring,
                         warc, whitening)
from skyfold.llm.common import table
from skyfold.llm.twins import TWINS
from skyfold.session import scratch_path


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary that fixes the ids, and the same as ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(text) -> Column:
    """SHA-256 in hexadecimal of a text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"), F.size("removed").cast("long").alias("n_intervals"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed",
                      digest(F.col("line_dedup.kept_text")).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "decontam.n_words", "decontam.n_hit", F.size("decontam.items").cast("long").alias("n_items"),
                      digest(F.array_join("decontam.items", ",")).alias("items_sha256"),
                      (F.col("decontam.n_hit") > 0).alias("contaminated"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_layout.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", F.length("visible_text").cast("long").alias("n_chars"), digest(F.col("visible_text")).alias("text_sha256"), "visible_text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["order"] < len(secret_scan.BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["order"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      digest(secret_scan.listed(base)).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                           "base_failed", "kept", "n_lines_removed")])


# A conversation of control strings, which every run formats beside the table's.
HOSTILE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(HOSTILE))
    out = chat.formatted(turns.union(own)).withColumn("turns", chat.turns_of(F.col("formatted")))
    learned = F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss")), "")
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(read).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                      digest(learned).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SHARDS = 8


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, scratch_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
QUERIES = dict(sorted(QUERIES.items(), key=lambda x: int(x[0][2:].split("_")[0])))
ORACLES = {name: TWINS[name] for name in QUERIES if name in TWINS}
