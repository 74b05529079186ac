"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages are toxicity (texts that the model rejects go), line dedup (lines that earlier documents hold go), SimHash near-dedup
(one document of each component stays), benchmark decontamination (contaminated documents go) and BPE (the kept texts' ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordinate.llm import bpe, decontam, line_dedup, simhash, toxicity
from ordinate.llm import common as C

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).filter("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.scan(docs, C.table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_texts(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("simhash", one_of_near_copies), ("decontamination", decontaminate), ("bpe", encode)]
#: Models, fingerprints and ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written to the shared folder and read again by the next, and goes once
    its successor is written. The last stage's input stays for the result that is returned."""
    docs, path = C.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs, read = stage(spark, docs, sf_dir), path
        if k < len(STAGES) - 1:
            docs, path = C.written(docs)
            if read:
                C.removed(spark, read)
    return docs
