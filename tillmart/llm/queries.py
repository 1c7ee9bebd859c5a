"""One query per operator, over its whole table, with the SQL it must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmart.operators.shared_storage import new_folder

from . import (
    bpe, chat_format, checksum, conversation_repair, exact_topk, merkle, pii, quality_classifier, quality_rules, secret_scan,
    simhash, source_mix, substring_dedup, token_rollup,
)
from .storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_quality_rules", quality_rules.ORACLE)
def _quality_rules(spark, sf_dir):
    return quality_rules.assess(table(spark, sf_dir, "documents"))


@query("op1_byte_bpe")
def _byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_simhash_bk_tree")
def _simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op6_secret_scan", secret_scan.oracle())
def _secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op8_source_mix", source_mix.oracle())
def _source_mix(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "first_position", "last_position")


@query("op2_substring_dedup", substring_dedup.ORACLE)
def _substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Texts that look like the template's own marks; they must come back as they went in.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


@query("op3_chat_format", chat_format.ORACLE)
def _chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(ODD_TEXT).alias("text"))
    turns = given.unionByName(odd).withColumn("parts", chat_format.text_parts(F.col("text")))
    read = chat_format.read_back(chat_format.format_conversations(turns))
    written = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op5_exact_topk", exact_topk.ORACLE)
def _exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", exact_topk.quantized(F.col("embedding")).alias("vector"))
    return exact_topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=20)


@query("op10_quality_classifier")
def _quality_classifier(spark, sf_dir):
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_token_rollup")
def _token_rollup(spark, sf_dir):
    """All documents are counted by two tokenizers; exact copies go; the word counter, which took only spaces for
    separators at first, is revised; the second batch is sent twice."""
    import public_tokenizers

    given, bpe_name, words_name = table(spark, sf_dir, "documents"), "byte_bpe_multi_50k", "words"
    path = public_tokenizers.path(f"{bpe_name}.tiktoken")
    tokens = bpe.encode(given, path, public_tokenizers.PATTERN, keep=("doc_id", "source", "lang"))
    by_space = F.regexp_count("text", F.lit(r"[^\x20]+"))
    rollup = token_rollup.Rollup(spark, new_folder(spark, "token-rollup"))
    rollup.apply("load", token_rollup.changes(tokens, "insert", bpe_name, F.size("tokens")).union(
        token_rollup.changes(given, "insert", words_name, by_space)))
    texts = given.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    first = stored(texts.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "copies")
    copies = texts.join(first, "h").filter("doc_id > first").withColumn(
        "name", F.explode(F.array(F.lit(bpe_name), F.lit(words_name))))
    for _ in range(2):
        rollup.apply("copies", token_rollup.changes(copies, "delete", F.col("name")))
    revised = source_mix.size_of(F.col("text"))
    rollup.apply("words-2", token_rollup.changes(given.filter(revised != F.coalesce(by_space, F.lit(0))), "revise",
                                                 words_name, revised))
    return rollup.totals()


@query("op11_pii_sanitise", pii.oracle())
def _pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op12_merkle_manifest", merkle.oracle(("doc_id", "source", "lang", "n_chars"), f"""CASE WHEN {checksum.crc32_sql(
    "doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"""))
def _merkle_manifest(spark, sf_dir):
    given = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    flat = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.coalesce(flat, F.col("text"))
    proved = merkle.manifest(given, merkle.record(*fields, F.col("text")),
                             keep={"changed": merkle.record(*fields, tampered)})
    return proved.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("path"))).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_conversation_repair", conversation_repair.oracle())
def _conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(given), given)
