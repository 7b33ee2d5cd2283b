"""The corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents. No stage reads ``documents`` of ``sf_dir``
by itself: models are fitted on docs.

- toxicity: a model trained from the labels of ``sf_dir`` on the whole texts of docs; documents that score
  0.5 or more go.
- language: context trees trained on those of docs that have a language; documents go whose
  best language needs over a bit a byte more than their own byte counts would, and those without a letter.
- near_duplicates: of documents linked at a Jaccard similarity of 0.75 over five-word shingles the one with
  the smallest id stays.
- repeats: words under windows of 50 that an earlier document has go; the others stay in place.
- packing: pieces of sequences of 2048 tokens.

Texts may be null or empty; such documents pass the first stage, and the second drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import packing, ppm, sigtree, substring, toxicity
from lodestone.llm.common import discard, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm.keep_identified(docs, ppm.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sigtree.keep_first(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", near_duplicates),
    ("repeats", remove_repeats),
    ("packing", pack),
]

#: No SQL: trained models, tokenizers and connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and deleted after the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
