"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

The lexicon is mined from labelled rows: words and word beginnings whose
document frequency among toxic texts is far above that among others. A text's
features are the lexicon densities and strengths, second-person words near
lexicon words, capitals, punctuation and obfuscation rates.

Folds are crossed, so that each labelled row serves for all three: a row's
features come from a lexicon that was mined without its fold, the calibration
uses scores of trees that were grown without it, and the model that scores has
the lexicon and the trees of all folds. Labelled rows are a sample bounded by
`most_labelled`, terms by `most_terms`; scoring runs where the documents are and
reads whole texts.

Defined results: null and empty texts have all features 0 and get a score;
null doc_id is not held out; repeated rows get equal scores; without labels of
both classes each score is the share of label 1 (0.5 without labels); an empty
table gives an empty result; other columns are not read by scores, and kept by
the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import hashing as hs
from almanac.llm.learning import Isotonic, Trees, boost, held_out, labelled_sample
from almanac.session import materialize, read

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos usted ustedes ti tus".split()
FEATURES = ("strong", "weak", "top", "sum", "rate", "hits", "near_you", "you", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "doubled", "length", "words")
BEGINNINGS = (4, 5, 6, 7, 8, 9)  # bytes
SLICE = 1 << 19

OTHER = np.ones(256, bool)  # what separates words: all but letters
OTHER[ord("a") : ord("z") + 1] = OTHER[ord("A") : ord("Z") + 1] = OTHER[0x80:] = False
MARKS, CALLS, LEET, CAPS = (np.zeros(256, bool) for _ in range(4))
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
CALLS[[ord("!"), ord("?")]] = True
LEET[[*map(ord, "0123456789@$*!|")]] = True
CAPS[ord("A") : ord("Z") + 1] = True
YOU = np.sort([hs.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), True)[0] for w in SECOND_PERSON])


@dataclass
class Lexicon:
    """Term hashes in order, their log odds, and a bitmap of their low bits."""

    terms: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.terms)
        self.terms, self.weight = self.terms[order], self.weight[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms & hs.U64(0xFFFFF)).astype(np.int64)] = True

    def of(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each hash, 0 where it is no term."""
        out = np.zeros(len(x))
        maybe = np.flatnonzero(self.bits[(x & hs.U64(0xFFFFF)).astype(np.int64)])
        if len(maybe) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, x[maybe]), len(self.terms) - 1)
            out[maybe] = np.where(self.terms[at] == x[maybe], self.weight[at], 0.0)
        return out


@np.errstate(over="ignore")
def terms(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings; 0 where a word has none."""
    found = [hs.word_hashes(lower, starts, ends)]
    lens = ends - starts
    for n in BEGINNINGS:
        h = np.zeros(len(starts), hs.U64)
        if (longer := np.flatnonzero(lens > n)).size:
            part = lower[starts[longer][:, None] + np.arange(n)].astype(hs.U64)
            power = np.cumprod(np.full(n, hs.MULTIPLIER[0], hs.U64), dtype=hs.U64)
            h[longer] = hs.mix((hs.TABLES[False, 1][part.astype(np.int64)] * power).sum(1, dtype=hs.U64) + hs.U64(n))
        found.append(h)
    return found


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


@np.errstate(over="ignore")
def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, class, texts) of (text, class) rows; a class is label and fold."""
    for b in batches:
        label = np.asarray(b.column(1)).astype(np.uint64)
        for lo, hi, data, offs in hs.slices(_lower(b.column(0)), SLICE):
            starts, ends, first = hs.words(data, offs, OTHER)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            for h in terms(data, starts, ends):
                keep = h != 0
                pair = np.unique(np.stack([h[keep], doc[keep].astype(hs.U64)]), axis=1) if keep.any() else np.zeros((2, 0), hs.U64)
                met, n = np.unique(np.stack([pair[0], label[lo:hi][pair[1].astype(np.int64)]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(met[0].view(np.int64)), pa.array(met[1].astype(np.int32)), pa.array(n.astype(np.int64))], ["term", "class", "n"])


@np.errstate(over="ignore", invalid="ignore")
def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    plain = texts.fill_null("")
    for lo, hi, data, offs in hs.slices(plain, SLICE):
        for sub_lo, sub_hi, lower, low_offs in hs.slices(_lower(plain.slice(lo, hi - lo)), 1 << 40):
            n = sub_hi - sub_lo
            starts, ends, first = hs.words(lower, low_offs, OTHER)
            count = np.diff(first)
            doc = np.repeat(np.arange(n), count)
            some = np.maximum(count, 1)
            whole, *begun = [lexicon.of(h) for h in terms(lower, starts, ends)]
            weak = np.max(begun, axis=0) if begun else whole
            best = np.maximum(whole, weak)
            hit = best > 0
            hits = np.bincount(doc, hit, n)
            top = np.zeros(n)
            np.maximum.at(top, doc, best)
            folded = hs.word_hashes(lower, starts, ends, True)
            you = np.isin(folded, YOU)
            at_you = np.concatenate([[0], np.cumsum(you)])
            pos = np.flatnonzero(hit)
            left, right = np.maximum(pos - 5, first[:-1][doc[pos]]), np.minimum(pos + 6, first[1:][doc[pos]])
            near = np.bincount(doc[pos], at_you[right] > at_you[left], n)

            def per_byte(flag: np.ndarray, offs: np.ndarray = offs) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(flag)])[offs])

            letter = ~OTHER[data]
            bytes_ = np.maximum(np.diff(offs), 1)
            inner = np.zeros(len(data), bool)
            if len(data) > 2:
                inner[1:-1] = LEET[data[1:-1]] & letter[:-2] & letter[2:]
            same = np.zeros(len(data), bool)
            same[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
            o_starts, o_ends, o_first = hs.words(data, offs, OTHER)
            caps = np.concatenate([[0], np.cumsum(CAPS[data])])
            loud = (caps[o_ends] - caps[o_starts] == o_ends - o_starts) & (o_ends - o_starts > 2)
            shouted = np.bincount(np.repeat(np.arange(n), np.diff(o_first)), loud, n) / np.maximum(np.diff(o_first), 1)
            total = np.bincount(doc, best, n)
            out[lo:hi] = np.stack([
                np.bincount(doc, whole > 0, n) / some, np.bincount(doc, weak > 0, n) / some, top, np.log1p(total), total / some,
                np.log1p(hits), near / np.maximum(hits, 1), np.bincount(doc, you, n) / some, per_byte(CAPS[data]) / bytes_, shouted,
                per_byte(MARKS[data]) / bytes_, per_byte(CALLS[data]) / bytes_, per_byte(inner) / some, per_byte(same) / some,
                per_byte(letter) / some, np.log1p(count),
            ], 1)
    return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return self.calibration(self.trees(features(texts, self.lexicon)))


def lexicon_of(terms_: np.ndarray, ones: np.ndarray, zeros: np.ndarray, rows: tuple[float, float], most: int, least_odds: float) -> Lexicon:
    """The terms that tell label 1 most, of those that enough texts have."""
    odds = np.log((ones + 0.5) / (rows[1] + 1.0)) - np.log((zeros + 0.5) / (rows[0] + 1.0))
    good = np.flatnonzero((ones >= max(3, rows[1] // 200)) & (odds > least_odds))
    good = good[np.lexsort((terms_[good], -odds[good] * np.sqrt(ones[good])))[:most]]
    return Lexicon(terms_[good].view(hs.U64).copy(), odds[good])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2, most_labelled: int = 24_000, most_terms: int = 4_000, least_odds: float = 2.0, folds: int = 5) -> Model:
    """The model of all labelled rows that are not held out. Of the terms, the
    5 * most_terms that tell most over all folds come to the driver, with their
    counts by fold."""
    sample = labelled_sample(docs, labels, label, parts, part, most_labelled).withColumn("fold", F.col("fold") % folds)
    sample = materialize(sample.select("text", "label", "fold"), "labelled")
    class_ = (F.col("fold") * 2 + F.col("label")).cast("int")
    rows = np.zeros((folds, 2))
    for r in sample.groupBy("fold", "label").count().collect():
        rows[r["fold"], r["label"]] = r["count"]
    zeros, ones = rows.sum(0)
    n = F.col("n")
    by = [F.sum(F.when(F.col("class") == c, n).otherwise(0)).alias(f"c{c}") for c in range(2 * folds)]
    counts = sample.select("text", class_.alias("class")).mapInArrow(mined, "term long, class int, n long").groupBy("term").agg(*by)
    of = {y: sum((F.col(f"c{2 * f + y}") for f in range(folds)), F.lit(0)) for y in (0, 1)}
    odds = F.log((of[1] + 0.5) / float(ones + 1)) - F.log((of[0] + 0.5) / float(zeros + 1))
    picked = counts.where(of[1] >= max(3, int(ones) // 250)).withColumn("rank", odds * F.sqrt(of[1])).where(odds > least_odds - 0.5)
    got = picked.orderBy(F.desc("rank"), "term").limit(5 * most_terms).drop("rank").toPandas()
    term, table = got["term"].to_numpy(np.int64), got[[f"c{c}" for c in range(2 * folds)]].to_numpy(float).reshape(-1, folds, 2)
    whole = lexicon_of(term, table[:, :, 1].sum(1), table[:, :, 0].sum(1), (zeros, ones), most_terms, least_odds)
    without = []
    for f in range(folds):
        rest = np.arange(folds) != f
        without.append(lexicon_of(term, table[:, rest, 1].sum(1), table[:, rest, 0].sum(1), tuple(rows[rest].sum(0)), most_terms, least_odds))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(2).to_numpy()
            for f in np.unique(fold):
                mine = b.filter(pa.array(fold == f))
                x = features(mine.column(0), without[f])
                yield pa.RecordBatch.from_arrays([mine.column(1), mine.column(2), *[pa.array(c) for c in x.T]], ["label", "fold", *FEATURES])

    schema = "label int, fold int, " + ", ".join(f"{f} double" for f in FEATURES)
    table = sample.mapInArrow(described, schema).toPandas().sort_values([*FEATURES, "label", "fold"])
    x, y, fold = table[list(FEATURES)].to_numpy(float), table["label"].to_numpy(float), table["fold"].to_numpy()
    crossed = np.zeros(len(y))
    for f in range(folds):
        crossed[fold == f] = boost(x[fold != f], y[fold != f])(x[fold == f])
    return Model(whole, boost(x, y), Isotonic.fit(crossed, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score under the threshold, all columns kept."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model(b.column(at).cast(pa.string())) < threshold))

    return docs.mapInArrow(rows, docs.schema)


def op9_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
