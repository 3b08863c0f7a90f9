"""The operators applied to their whole tables, as the driver asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm import (
    chat, decontaminate, extraction, line_dedup, mil, near_dedup, packing, quality_rules, runs, search, sharding, token_counts, warc,
)
from haulframe.llm.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written to an archive and read back."""
    path = new_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.record_report(warc.read_archive(spark, path))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("items")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines that are not blank, and the numbers of those that go."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "emptied")


def pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(
        docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_lines")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=16)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template itself, folded from logs of streamed, edited and
    regenerated messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    log = chat.streamed_log(rows.unionByName(more))
    return chat.digests(chat.read_back(chat.render(chat.fold_events(log, chat.STREAMED))))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).drop("key")


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The words of a tenth of the documents, chosen by their id, repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("_words")
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    tail = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn(
        "text", F.when(n > 0, planted).otherwise(F.col("text"))
    ).drop("_words")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, after planting some, and what collapsing them leaves."""
    found = runs.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.withColumn("best", runs.strongest())
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        digest(F.array_join(listed, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_shards": op6_shards,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_chat": op10_chat,
    "op11_extraction": op11_extraction,
    "op12_runs": op12_runs,
    "op13_search": op13_search,
}
