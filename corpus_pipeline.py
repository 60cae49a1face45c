"""Corpus cleaning: language ID, near-duplicates, benchmark decontamination, then BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's documents; what the stage wrote on its way, and the output of the stage before, is
then deleted. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodekv.llm import bpe, decontaminate, langid, simhash
from lodekv.runtime import discard, materialize, scratch, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language model accepts them; models are learned from the labelled ones of all documents."""
    models = langid.fit(docs)
    row = F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
    judged = langid.identify(docs.select(row.alias("__row"), "text"), models, keep=["__row"])
    return judged.where("accepted").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: one with the group's smallest id."""
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, by their digests."""
    out = bpe.encode_decode(docs, keep=["doc_id"], values=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Character models and fingerprint components are not expressible in SQL; see tests/llm/test_tables.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            out = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
