"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm import chat, licenses, mixing, packing, quality
from mirage.llm.common import table
from mirage.llm.exact_dedup import exact_dedup
from mirage.llm.lexical import lexical_search
from mirage.llm.ngram_join import ngram_join
from mirage.llm.projection_search import nearest_neighbours
from mirage.llm.spelling import spelling_variants
from mirage.llm.substring_dedup import remove_repeats
from mirage.llm.token_files import token_rows
from mirage.llm.vector_dedup import near_vectors

#: Where the tokenizers are; None: the installed package of public ones.
TOKENIZERS: str | None = None
QUALITY_TAIL = 0.5

# The mix: the domain is the source's number modulo 3, weights by name.
DOMAINS = ["web", "books", "code"]
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}, "source": {"src0": 3}}


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def domain() -> F.Column:
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return F.when(number != "", F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (number.cast("long") % len(DOMAINS) + 1).cast("int"))).otherwise("")


def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, d, "documents"), licenses.known_licenses(spark)).withColumn(
        "notices", F.array_join("notices", ","))


def rated(spark: SparkSession, docs: DataFrame, d: str, carry: list[str] | None = None) -> DataFrame:
    model = quality.train(docs, quality.grades(table(spark, d, "labels")), quality.N_GRADES)
    return quality.rate(docs, model, quality.N_GRADES, carry)


def op2_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    rows = rated(spark, table(spark, d, "documents").select("doc_id", "text"), d, ["doc_id"])
    return rows.select("doc_id", "expected_grade", F.col("tail")[0].alias("p_grade_1"), F.col("tail")[1].alias("p_grade_2"),
                       quality.keeps(1, QUALITY_TAIL).alias("kept"), quality.keeps(2, QUALITY_TAIL).alias("clean"))


def op3_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_sources(docs, domain(), WEIGHTS, share=0.8, epochs=2).select(
        "doc_id", domain().alias("domain"), "lang", "source", "epoch", "n_tokens", "take_tokens")


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenise(docs, tokenizer("byte_bpe_50k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, packing.groups_for(docs), ["doc_id", "piece", "ids_crc32"])


def op4_pattern_packing(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"))


EXTRA_CHAT = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


def op5_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA_CHAT, "conv_id long, turn long, role string, text string"))
    records = rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    turns = chat.gather_turns(chat.canonical_turns(records), "conv_id", "turn")
    done = chat.format_chats(turns).select("conv_id", "formatted", "loss_spans")
    back = done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), "formatted",
                       chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return remove_repeats(table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup(table(spark, d, "documents").select("doc_id", "text")).drop("text")


def op8_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join(table(spark, d, "documents"))


def op9_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(spark, table(spark, d, "documents"), tokenizer("word_bpe_49k.json")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(table(spark, d, "embeddings"))


def op11_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical_search(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"))


def op12_projection_search(spark: SparkSession, d: str) -> DataFrame:
    return nearest_neighbours(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling_variants(table(spark, d, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_quality_classifier, op3_source_mixing, op4_pattern_packing, op5_chat_formatting,
                            op6_substring_dedup, op7_exact_dedup, op8_ngram_jaccard_join, op9_token_files, op10_vector_dedup,
                            op11_lexical_search, op12_projection_search, op13_spelling_variants, pipeline)}
