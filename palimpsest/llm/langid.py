"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent n-grams in the training texts, a
document's that of its own.  The out-of-place distance sums how far each n-gram of the
document stands from its place in the profile; the nearest profile wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Length of a profile; n-grams have one to three characters and never cross a word.
PROFILE = 300
#: More languages than this are no language column; it bounds the broadcast profiles.
MOST_LANGUAGES = 10_000
UND = "und"
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Code point to itself for letters, to a blank for all else."""
    points = np.arange(0x110000, dtype=np.uint32)
    keep = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(keep, points, np.uint32(_SPACE)).astype(np.uint32)


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased letters of a text, words apart by one blank, blanks at both ends."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate(([_SPACE], codes, [_SPACE])).astype(np.uint64)
    blank = codes == _SPACE
    return codes[~(blank & np.append(False, blank[:-1]))]


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams as integers of 21 bits a character."""
    if len(codes) < 3:
        return np.empty(0, np.uint64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    s = np.uint64(21)
    inner = b != _SPACE
    ones = codes[1:-1][inner]
    twos = (codes[:-1] << s) | codes[1:]
    threes = ((a << (s + s)) | (b << s) | c)[inner]
    return np.concatenate([ones, twos, threes])


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    values = np.sort(values)
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[edge], np.diff(np.append(edge, len(values)))


def top(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent values in order; of equally frequent ones the smaller first."""
    if not len(values):
        return values
    distinct, counts = counted(values)
    if len(distinct) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        near = counts >= least
        distinct, counts = distinct[near], counts[near]
    return distinct[np.argsort(-counts, kind="stable")][:n]


def _word_grams(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of counted words, each as often as its words occur."""
    names = list(words)
    codes = np.frombuffer((" " + " ".join(names) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    times = np.fromiter(words.values(), np.int64, len(names))
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    weight = np.zeros(len(codes), np.int64)
    weight[1:] = np.repeat(times, lengths + 1)  # a word's characters and the blank after it
    lead = np.zeros(len(codes), np.int64)  # the weight of the word that begins after this blank
    lead[np.cumsum(lengths + 1) - lengths - 1] = times
    s = np.uint64(21)
    inner = codes[1:-1] != _SPACE
    head = np.where(codes[:-1] == _SPACE, lead[:-1], weight[:-1])
    values = np.concatenate([codes[1:-1][inner], (codes[:-1] << s) | codes[1:], ((codes[:-2] << (s + s)) | (codes[1:-1] << s) | codes[2:])[inner]])
    weights = np.concatenate([weight[1:-1][inner], head, weight[1:-1][inner]])
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weights=weights).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, pd.Series] = {}
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            clean = letters_only(text).astype(np.uint32).tobytes().decode("utf-32-le")
            words.setdefault(lang, Counter()).update(clean.split())
        for lang, found in words.items():
            if found:
                values, counts = _word_grams(found)
                part = pd.Series(counts, index=values.astype(np.int64))
                totals[lang] = part if lang not in totals else totals[lang].add(part, fill_value=0)
    for lang, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(total.index, pa.int64()), pa.array(total.to_numpy().astype(np.int64))], names=["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, *, size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank`` of the ``size`` most frequent n-grams of each language, rank from 0.

    All rows of ``labelled(lang, text)`` count; those without a lang or a text teach
    nothing.  Ties go to the smaller n-gram.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram").asc()]
    # the best of each sixteenth first, so that no task orders all n-grams of a language
    part = counts.withColumn("_part", F.pmod(F.xxhash64("gram"), F.lit(16)))
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= size)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Rank-order profiles as arrays: one row per n-gram, one column per language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram)), at[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name of several, and 1 - distance / worst distance."""
        best = top(grams(letters_only(text or "")), self.size)
        if not len(best) or not self.langs:
            return UND, 0.0
        at = np.searchsorted(self.grams, best)
        hit = (at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == best)
        ranks = self.ranks[np.where(hit, at, len(self.grams))]
        away = np.abs(ranks - np.arange(len(best))[:, None])
        distance = np.where(ranks < 0, self.size, away).sum(axis=0)
        k = int(np.argmin(distance))
        return self.langs[k], float(1 - distance[k] / (self.size * len(best)))


def predict_languages(docs: DataFrame, profiles: DataFrame, *, size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); only ``text`` is looked at.

    Texts that are null or have no letters are ``und`` with score 0, as are all where no
    language was learned.  Columns of those two names are replaced; rows, repeats and all
    other columns stay as they are.
    """
    spark = docs.sparkSession
    rows = profiles.select("lang", "gram", "rank").limit(MOST_LANGUAGES * size + 1).collect()  # size rows a language
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
    holder: dict[str, Profiles] = {}

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        if "p" not in holder:
            holder["p"] = Profiles(shared.value, size)
        return pd.DataFrame([holder["p"].predict(x) for x in texts], columns=["lang_pred", "score"])

    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "_p")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], predicted("text").alias("_p")).select(*[F.col(f"`{c}`") for c in keep], "_p.lang_pred", "_p.score")


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: a quarter, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~held_out()))
    return predict_languages(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).drop("text")
