"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Null, empty and repeated rows are handled as each operator's module states; rows that share
a doc_id are judged each by its own text, and none goes because another one of its id does. Once a
stage's result is written, what the stage kept in the shared folder is deleted, as is the result
before it. Where stages are called one by one, as by the check tool, what a stage kept goes when the
next one begins, unless that one's docs still read it: results must be written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, common, decontaminate, neardup, pii, toxicity

#: Scratch tables of stages called so far that haven't been deleted.
_kept: list[str] = []


def _tidied(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _kept else []
        done = [p for p in _kept if not any(p.rsplit("/", 1)[1] in f for f in read)]
        common.drop(spark, done)
        common.trim_driver(spark)
        since = common.given()
        out = stage(spark, docs, sf_dir)
        _kept[:] = [p for p in _kept if p not in done] + common.given_since(since)
        return out

    return run


STAGES = [
    ("toxicity", _tidied(toxicity.stage)),
    ("near_duplicates", _tidied(neardup.stage)),
    ("decontamination", _tidied(decontaminate.stage)),
    ("pii", _tidied(pii.stage)),
    ("bpe", _tidied(bpe.stage)),
]

#: The stages' models, fingerprints and merges aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    since = common.given()
    for name, stage in STAGES:
        docs, path = common.written_at(stage(spark, docs, sf_dir), f"stage-{name}")
        common.clear(spark, since, keep=(path,))
    return docs
