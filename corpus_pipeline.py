"""A corpus pipeline of five stages, each of which calls one operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of docs. Each stage runs on all that
the one before kept, whole texts, whatever the columns hold: null ids stay,
null texts count as empty, repeated rows are treated alike, empty tables give
empty results, and other columns pass through.

SQL cannot express these stages (a learned model, sketches, a tokenizer), so
ORACLE_SQL is None; tests hold each stage against brute force on what it was
given: the classifier's scores, all pairs of texts, all benchmark items, the base
patterns, and the tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import decontamination, neardup, packing, secrets, toxicity
from almanac.session import forget, made, materialize, read, ship

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 or more, the one of
    smallest doc_id stays."""
    ship(spark)
    return neardup.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_items(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return secrets.masked(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised documents, packed into sequences of 4096."""
    import public_tokenizers

    ship(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(materialize(pieces, "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and reread, and
    then what the stage wrote besides is deleted, its input too."""
    docs, since = read(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, since, made() - 1)
    return docs
