"""Stages of the pipeline read what they are given."""

import shutil

import corpus_pipeline
from lodestone.llm.common import scratch, table

SF = "/root/testdata/sf0.001"


def test_later_stages_do_without_the_documents(spark, tmp_path):
    """The documents go when the first stage is written; the second has docs and the other tables."""
    for name in ("documents", "labels"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    (_, first), (_, second) = corpus_pipeline.STAGES[:2]
    docs = scratch(first(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)), "first")
    (tmp_path / "documents.parquet").unlink()
    kept = scratch(second(spark, docs, str(tmp_path)), "second")
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
