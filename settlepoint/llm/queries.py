"""The registered opN_<name> queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, delta_lloyd, exact_dedup, filter_audit, langid, line_dedup, mixing, ngram_join, packing, quality, url_rules, vptree, warc
from .common import table


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(table(spark, sf_dir, "documents"))
    return planned.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken")
    )


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = quality.labelled_sample(table(spark, sf_dir, "labels"), _remainder(4) != 2)
    model = quality.fit(docs.join(sample, F.col("doc_id") == F.col("label_id")))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.fit(docs.where(_remainder(3) != 1))
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return langid.predict(marked, trees).select("doc_id", "held_out", "lang_pred", "score")


def op8_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5, relax=1.0)


def op10_chat_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    added = spark.createDataFrame(own, "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(rows.unionByName(added)))


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.pages_as_payloads(table(spark, sf_dir, "pages"))
    folder = warc.new_folder(spark)
    archives = warc.write_archives(pages, folder, dedup_bytes=0)
    requests = pages.select("page_id", warc.reversed_host_key(F.col("url")).alias("key"))
    return warc.read_captures(requests, folder, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_bayesian_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_join(table(spark, sf_dir, "documents"), threshold=0.8, n=5)
    return found.select("doc_id", "class_id", "n_links", "copy_id")


def op6_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_join(table(spark, sf_dir, "documents"), k=2, chars_per_edit=10)


def op11_relational_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


#: The given rules: (verdict, host, path).
POLICIES = [
    url_rules.Policy("allow", "com", "/"),
    url_rules.Policy("block", "example.com", "/en/"),
    url_rules.Policy("allow", "www.example.com", "/en/"),
    url_rules.Policy("block", "net", "/es/"),
    url_rules.Policy("block", "net", "/fr/"),
]


def op12_association_rule_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, POLICIES, default="allow", min_support=0.01, min_confidence=0.9)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return delta_lloyd.cluster(vectors, k=8, rounds=10, dims=64, scale=1024, seed=3)
