"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``documents``, and leave other columns out; ``n_chars`` follows the text where a stage changes it.

Defined cases: a null text is an empty one from the repeats stage on, and as such one token, the end, when it is packed; a
text without a word isn't toxic, and all such texts are near duplicates of one another; of rows that share a doc_id all stay
or none in the near-duplicate stage, and each is packed; a null doc_id is never held out, the largest in the repeats stage,
and one of a group of near duplicates that all have none stays; texts of any length are worked on whole; a repeated row is a
near duplicate that goes unless it shares the doc_id; an empty table gives none at every stage. Without labels of both
classes nothing is toxic. Pseudonyms take their key from spark.tidemark.pii.key, see ``pii.key_of``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, pii, repeats, toxicity
from tidemark.llm.common import cut, table, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidied(stage: Stage) -> Stage:
    """The stage, begun without what the ones before it have left in the driver."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return stage(spark, docs, sf_dir)

    return run


@tidied
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay; the model learns from the labels that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs.select(COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


@tidied
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more, that of the smallest id of each group stays; candidates
    come from the Gray-order index over several SimHashes."""
    return neardup.keep_one(docs.select(COLUMNS))


@tidied
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id has too are cut out; every document stays, with the rest of its text."""
    marked = repeats.mark_repeats(docs.select(COLUMNS), with_kept=True)
    return marked.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("bigint")).select(COLUMNS)


@tidied
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values get their pseudonyms."""
    return pii.pseudonymise(docs.select(COLUMNS), pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


@tidied
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Models, fingerprints and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is checkpointed before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
