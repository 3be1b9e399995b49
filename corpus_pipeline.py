"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Every stage takes whole texts. A row with a null id is a document of its own; what rows of one id and a null or empty
text come to is said with each stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import decontamination, linededup, packing, simhash, toxicity
from canopy.llm.common import materialize, read
from canopy.llm.queries import word_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on a bounded sample of all labelled documents.

    Null and empty texts have no window and stay, unless all labels are toxic. Without labels nothing is rejected.
    Rows of one id are judged each.
    """
    model = toxicity.fit_on(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on ten sites or more are taken out; every document stays, n_chars follows its text.

    Null texts stay null, with a null n_chars. A null source is no site; a line counts once a site.
    """
    out = linededup.remove(docs, min_sites=10)
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    SimHash fingerprints within 3 bits give the first candidates, exact similarity decides, and what fingerprints can't
    tell is found by shared shingles.

    Documents without words, null texts among them, are copies of each other. Rows with a null id stay; of rows with one
    id each is a document, and of equal ones one stays.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of the five-word shingles of a benchmark item go.

    An item of fewer words is one shingle; one without words matches nothing. Null and
    empty texts and rows with a null id stay; an id goes with all its rows.
    """
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as pieces of sequences of at most 2048 tokens.

    A null or empty text is its end alone; ties of length are packed in any order.
    """
    return packing.pack(docs, word_tokenizer(), capacity=2048, remember=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can't express the compression distance and the tokenizer; tests/llm/test_queries.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
