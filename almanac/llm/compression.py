"""Quality by compression: zstandard dictionaries of good and of bad text.

Blocks of labelled texts train one dictionary for each class. A text is cut
into blocks of the same size; each block is compressed with either dictionary,
apart from its neighbours, so that the dictionaries count as much in a long
text as in a short one. The normalised difference of the summed sizes,
(bad - good) / length, becomes a score by isotonic calibration on
labelled rows that trained no dictionary.

Bounds, as parameters: `most_labelled` labelled rows are read; each class's
dictionary is trained on `most_blocks` of their blocks and has `dict_bytes`.
Scoring runs where the documents are, over whole texts.

Defined results: null and empty texts have difference 0 and get its calibrated
score; a null doc_id is never held out; repeated rows get equal scores;
without labels of both classes each score is the share of label 1 (0.5
without labels); an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.learning import Isotonic, held_out, labelled_sample
from almanac.session import read

BLOCK = 4096


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; their plain text where they are
    too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibration: Isotonic
    level: int = 3

    def differences(self, texts: pa.Array) -> np.ndarray:
        """The normalised size difference of each text."""
        out = np.zeros(len(texts))
        if not self.good or not self.bad:
            return out
        sides = []
        for d in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level=self.level)
            sides.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        for i, t in enumerate(texts):
            text = (t.as_py() or "").encode()
            if text:
                g, b = (sum(len(f(x)) for x in blocks(text)) for f in sides)
                out[i] = (b - g) / len(text)
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return self.calibration(self.differences(texts))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, part: int = 1, most_labelled: int = 24_000, most_blocks: int = 3_000, dict_bytes: int = 64 << 10) -> Model:
    """Folds 0-4 of the labelled sample train the dictionaries, 5-9 the
    calibration."""
    sample = labelled_sample(docs, labels, label, parts, part, most_labelled)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = list(blocks((t.as_py() or "").encode()))
                for at in range(0, len(found), 256):
                    part_ = found[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(part_), pa.int32()), pa.array(part_, pa.binary())], ["label", "block"])

    cuts = sample.where(F.col("fold") < 5).select("text", "label").mapInArrow(cut, "label int, block binary")
    texts = {y: [bytes(r["block"]) for r in cuts.where(F.col("label") == y).orderBy(F.xxhash64("block"), "block").limit(most_blocks).collect()] for y in (0, 1)}
    plain = Model(dictionary(texts[1], dict_bytes) if texts[1] else b"", dictionary(texts[0], dict_bytes) if texts[0] else b"", Isotonic())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(plain.differences(b.column(0)))], ["label", "raw"])

    table = sample.where(F.col("fold") >= 5).select("text", "label").mapInArrow(measure, "label int, raw double").toPandas().sort_values(["raw", "label"])
    plain.calibration = Isotonic.fit(table["raw"].to_numpy(float), table["label"].to_numpy(float))
    return plain


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, score double")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
