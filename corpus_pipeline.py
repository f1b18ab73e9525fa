"""From documents to packed training sequences, one operator after the other; each stage works on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segflow.llm import factors, icws, neighbours, packing, simhash
from segflow.llm.common import discard, scratch_scope, stored
from segflow.llm.queries import tokenizer_path

#: Scratch tables of the stage before, deleted when the next stage begins on other files.
_BEFORE: list[str] = []


def _stage(function):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        if not any(path.rsplit("/", 1)[-1] in file for path in _BEFORE for file in read):
            discard(spark, _BEFORE)
            _BEFORE.clear()
        with scratch_scope(_BEFORE):
            return function(spark, docs, sf_dir)

    run_stage.__doc__ = function.__doc__
    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5; a text without telling words, also null or empty, is kept."""
    model = neighbours.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return neighbours.without_toxic(docs, model)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id."""
    return icws.one_of_each(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 50-word windows that also start in a document with a smaller id."""
    return factors.without_repeats(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return simhash.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens. Its scratch stays: the result is read from it."""
    if not any(path.rsplit("/", 1)[-1] in file for path in _BEFORE for file in docs.inputFiles()):
        discard(spark, _BEFORE)
        _BEFORE.clear()
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The stages are trained or use tokenizers, so SQL cannot express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
