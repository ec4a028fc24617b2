"""Registered queries of the text operators, on the whole given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators.store import new_path, written

from . import chat, crosstok, exact_dedup, fim, langid, licenses, mixing, packing, pii, quality, setjoin, spotsigs, warc
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_chat_format", chat.OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(chat.HOSTILE, "conv_id long, turn long, role string, text string")
    return chat.read_chats(chat.format_chats(turns.unionByName(hostile)))


@query("op5_exact_dedup", exact_dedup.OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True).drop("bucket")


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.with_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", quality.score_statistics(model, F.col("stats")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")
    model = langid.fit(docs, path)
    found = langid.predict(docs, model, path)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op4_warc", warc.OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_spot_signatures")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.classes(table(spark, sf_dir, "documents"), setjoin.Rule(n=3, num=9, den=10))


@query("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op12_fill_in_middle", fim.OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


@query("op13_cross_tokenizer")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.cross_align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
