"""A corpus run: the stages that turn documents into packed training windows.

Each stage gets all that the one before kept, as Parquet read again, and all but the
last return the columns of documents. run() writes the results between stages in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import minhash, mixing, packing, substrings, toxicity
from lodeframe.llm.registry import fold, table
from lodeframe.llm.tables import scratch, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the training fold of labels, doesn't reject.

    A null text scores as an empty one, a text of any length as a whole; repeated rows and null ids are rows like any other. Without
    labels nothing is rejected.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=fold("id", 4) != 2)
    return toxicity.score(docs, model, result="_score", predicted="_toxic").filter("_toxic = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id, and of equal ids one of them.

    Rows are near by their own texts, so rows that repeat an id with unrelated texts all stay. Rows with a null id and those
    without words are in no group and stay. Columns may have any names.
    """
    return minhash.firsts(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that occur elsewhere too; those left without words go. n_chars follows the text.

    Null and empty texts stay as they are. Repeated rows are documents of their own: if longer than a window, they go. Columns
    may have any names.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]  # columns of docs may have names of the operator's results
    at = {c: p for c, p in zip(docs.columns, plain, strict=True)}
    names = [{"doc_id": "doc_id", "text": "text"}.get(c, p) for c, p in at.items()]
    out = substrings.dedup(docs.toDF(*names)).filter("n_removed < n_words or n_words = 0")
    if "n_chars" in at:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(at["n_chars"], F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col(at["n_chars"])))
    return out.select(*names).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts weigh nothing and come as often as others of their source; a null source is a source; null ids and repeated
    rows are rows like any other. Columns may have any names.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows; a null or empty text is its closing id alone, an empty table gives no piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: models, components and BPE ids can't be expressed in SQL; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over the table before it, which stays for as long as it is read; all others are dropped."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-2]:
            with scratch(spark):
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        name, stage = STAGES[-2]
        with scratch(spark):
            docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
