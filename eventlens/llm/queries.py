"""One query per operator over the shared test tables, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import bpe, chat, embeddings, jaccard, lexical, licenses, mixing, quality, records, simhash, spelling, toxicity, warc
from eventlens.llm.common import work_dir
from eventlens.llm.oracle import ORACLES  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "records")
    records.write(table(spark, sf_dir, "documents"), path, VOCABULARY)
    index = records.index(spark, path).select("part", "offset", "doc_id", "start", "n_tokens", "ids_crc32")
    # The same records once more, as a reader that shuffles gets them: by their places in the index, in a drawn order.
    again = records.fetched(spark, path, records.turns(spark, path, seed=1), digest=True)
    return index.join(again.select("part", "offset", "fetched_crc32"), ["part", "offset"]).drop("part", "offset")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"]).drop("lossless")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = mixing.sizes(docs).select("doc_id", "source", "size")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A conversation that says what other templates use as control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = [F.struct(F.lit(-1).alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL).alias("text")) for k, role in enumerate(("user", "assistant"))]
    own = spark.range(1).select(F.inline(F.array(*two)))
    return chat.read_back(chat.examples(turns.unionByName(own)))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_simhash, op3_toxicity, op4_token_records, op5_jaccard, op6_embeddings, op7_bpe, op8_mixing, op9_warc, op10_chat, op11_spelling, op12_lexical, op13_licenses, pipeline)
}
