"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import decontam, minhash, packing, secrets, toxicity
from leakloom.session import materialize

#: Documents with this toxicity score or more go, and those of whose words benchmark windows cover any.
TOXIC = 0.3
#: Similarity of near-duplicates, of sets of five words; op5 has its own.
NEAR = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled rows that are not held out.

    Each row is judged by its text, whatever its id; a null text is scored as an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels, lambda c: ~toxicity.held_out(c)), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, of the smallest id.

    Rows are numbered and told apart by their numbers, so rows that repeat an id, or have none, are
    members of groups like others. Rows without words are in no group and stay.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), whole), "numbered")
    linked = minhash.link(rows.select("row", "whole.doc_id", "whole.text"), similarity=NEAR, row_col="row")
    return rows.join(linked.filter("not chosen").select("row"), "row", "left_anti").select("whole.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text a benchmark window occurs go, whatever their id; null and empty texts stay."""
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars follows; rows without any stay as they are, and none goes."""
    sample = secrets.samples(docs)
    table = secrets.train(sample)
    return secrets.mask_texts(docs, table, secrets.limits(sample, table))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens; a null text is an empty document, and each row is packed."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: Stages learn models and tokenize: SQL does not express them; tests hold the run against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
