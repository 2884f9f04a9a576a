"""The operators as registered queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import block_naming, chat_hmm, collocations, decontaminate, hard_negatives, imatch, jaccard_join, line_dedup, mixing, quality_mil, suffix_dedup, token_files, warc_revisit
from tillpoint.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_docs", "n_links")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path(token_files.TOKENIZER)
    return token_files.token_table(table(spark, sf_dir, "documents"), path)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve_revisits(warc_revisit.records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(F.expr("record_id div 2").alias("page_id"), "outcome", F.expr("target div 2").alias("target_page"),
                        "validator", F.col("digest").alias("payload_md5"), F.array_join(lines, "\n").alias("headers"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, name, best = quality_mil.score(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_mil.held_out().alias("held_out"), F.col(name).alias("score"),
                         (F.col(name) >= quality_mil.THRESHOLD).cast("int").alias("predicted"), F.col(best).alias("top_passage"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, names = mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", F.col(names["size"]).alias("size"), F.col(names["source_size"]).alias("source_size"),
                          F.col(names["target"]).alias("target"),
                          (F.col(names["copies"]) * F.col(names["size"])).alias("taken"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_hmm.transcripts_of(table(spark, sf_dir, "conversations"))
    model = chat_hmm.fit(rows.filter(~chat_hmm.held_out()))
    found = chat_hmm.format_chats(rows, model)
    # The true role of each row, beside the recovered one; rows that agree in all else differ in it at most.
    true = rows.groupBy(F.xxhash64("conv_id", "turn", "raw").alias("key")).agg(F.min("role").alias("role"))
    return found.join(true, "key").select("conv_id", "turn", chat_hmm.held_out().alias("held_out"), "role",
                                          F.element_at("roles", 1).alias("recovered"), F.size("roles").alias("n_lines"), "rendered")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return found.select("doc_id", F.col("units").alias("n_units"), F.size("removed").cast("long").alias("n_removed"),
                        removed.alias("removed_bytes"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, n = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col(n["n_words"]).alias("n_words"), F.col(n["n_hit"]).alias("n_hit"),
                        F.size(n["hit_items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(n["hit_items"], ","), 256).alias("items_sha256"),
                        (F.col(n["n_hit"]) > 0).alias("contaminated"))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.fingerprints(table(spark, sf_dir, "documents"))
    text = {c: F.lower(F.hex(c)) for c in ("sha", "mark", "edited_mark")}
    return found.select("doc_id", "n_chars", text["sha"].alias("edited_sha256"), text["mark"].alias("fingerprint"),
                        text["edited_mark"].alias("edited_fingerprint"), "near_edited", "near_next")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


EXACT_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             sha256(t) AS text_sha256
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc_revisit": op4_warc_revisit,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_imatch": op11_imatch,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op3_exact_dedup": EXACT_SQL,
    "op4_warc_revisit": warc_revisit.REVISIT_SQL,
    "op7_mixing": mixing.MIX_SQL,
    "op9_line_dedup": line_dedup.LINES_SQL,
    "op12_collocations": collocations.COLLOCATIONS_SQL,
    "op13_hard_negatives": hard_negatives.NEGATIVES_SQL,
}
