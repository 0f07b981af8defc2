"""One query per operator over its whole table, with the SQL counterpart where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourclocks.llm import alignment, bpe, exact_dedup, html, merkle, minhash, packing, quality, resharding, secrets, token_files, toxicity, vectors
from fourclocks.llm.common import fresh, table
from fourclocks.llm.labels import remainder

#: The score from which a document counts as label 1; the packed sequence; the end id of token files.
CUT, WIDTH, END, STOP = 0.3, 1024, 2, 0


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, folder, "documents"), rank_file, public_tokenizers.PATTERN, with_ids=False)


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rules = secrets.BASE + secrets.MORE
    found = secrets.scan(table(spark, folder, "documents"), rules)
    base = F.filter("found", lambda x: x["kind"] < len(secrets.BASE))

    def number(kind: int):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secrets.listed(base, rules), 256).alias("base_sha256"),
        secrets.listed(F.col("found"), rules).alias("spans"),
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    pieces = packing.document_pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END, WIDTH)
    return packing.pack(pieces, WIDTH).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_resharding(spark: SparkSession, folder: str) -> DataFrame:
    old = F.pmod(F.crc32(F.col("source")), F.lit(16))
    return resharding.reshard(table(spark, folder, "documents"), old, 16)


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), remainder("doc_id", 5) == 0
    model = quality.train(docs, table(spark, folder, "labels"), "quality", ~held)
    return judged(quality.score(docs, model), held)


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars", "path")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.equal_texts(table(spark, folder, "documents"))


def op9_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"), 0.95)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), remainder("doc_id", 4) == 2
    model = toxicity.train(docs, table(spark, folder, "labels"), "toxic", ~held)
    return judged(toxicity.score(docs, model), held, "n_spans", "spans")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs, fields = table(spark, folder, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(docs, merkle.record_hash([F.col(c) for c in fields]), F.when(hit, merkle.record_hash(tampered)))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, place, path = table(spark, folder, "documents"), fresh(spark, "token-files"), public_tokenizers.path
    token_files.write_files(docs, place, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, STOP)
    return token_files.read_files(spark, place, docs.schema["doc_id"].dataType)


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path
    files = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model")
    return alignment.align_documents(table(spark, folder, "documents"), *files)


def judged(scored: DataFrame, held, *more: str) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), *more)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_secrets, op3_packing, op4_resharding, op5_minhash, op6_quality, op7_html, op8_exact_dedup, op9_vectors,
        op10_toxicity, op11_merkle, op12_token_files, op13_alignment,
    )
}
