"""The registered queries of the thirteen operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.llm import bpe, chat, collocations, embed_dedup, html_extract, line_dedup, minhash, packing, pii, quality, spelling, substring, topk
from vellumetry.llm.common import read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.texts(read_table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql("select cast(-1 as bigint) conv_id, cast(k as bigint) turn, r role, :said text from values (0, 'user'), (1, 'assistant') as t(k, r)", args={"said": said})
    return chat.digests(rows.unionByName(own))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_main_text,
        op2_embedding_near_dedup,
        op3_chat_format,
        op4_bpe_round_trip,
        op5_minhash_near_dedup,
        op6_best_fit_packing,
        op7_personal_data,
        op8_line_dedup,
        op9_quality_rules,
        op10_repeated_passages,
        op11_spelling_variants,
        op12_top_scores,
        op13_collocations,
    )
}

#: SQL for those that it can express: op7's base columns and op9's verdicts can't be had whole, so none is given.
SQL: dict[str, str] = {}
