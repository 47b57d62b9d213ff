"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing, BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.

In every stage a null text counts as empty, texts are read whole however long, extra columns of any name are carried
along (but the last stage replaces columns named n_tokens and ids and drops one named decoded), and an empty table gives an empty result. Rows that repeat a doc_id are rows of their own, treated alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entroflow.llm import bpe, linededup, mixing, neardup, quality, queries
from entroflow.llm.common import col, docs_table, fresh, stage


def _carried(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *added: str) -> DataFrame:
    """step(docs) in the columns of `docs`: its own columns of names that the step adds are kept out of its way."""
    names = [c for c in docs.columns if c.lower() in added]
    aside = dict(zip(names, fresh(docs, *(f"_{c}" for c in names))))
    out = step(docs.withColumnsRenamed(aside))
    return out.select([col(aside.get(c, c)).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents of the corpus, doesn't reject. Null and empty
    texts score the share of good labels; ties at the threshold stay."""
    model = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _carried(docs, lambda d: quality.score(d, model).filter("predicted = 1"), "score", "predicted")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text. A line stays in the
    largest doc_id that holds it (in all rows of that id); a document whose lines all go stays, with an empty text."""
    out = _carried(docs, linededup.drop_repeated_lines, "n_lines", "n_dropped")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest
    doc_id, in all its rows. Documents without words and those without an id stay."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass that takes words of a document, with its whole text or the words taken. Documents
    without words stay, once; a null source is a source."""
    return mixing.mix_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and token ids, packed as little-endian 32-bit integers; none for a text without words."""
    return bpe.encode(docs, queries.vocabulary(), remember=60_000)  # the workers hold other stages' state besides


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", to_tokens),
]

#: No SQL for a trained classifier; the tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each but the last is written to the shared folder and read again."""
    docs = docs_table(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
