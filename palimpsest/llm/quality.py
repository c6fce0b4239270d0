"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a sum of log odds of its words and of bins of its shape, for
features whose association with the labels is beyond chance.  Hosts and paths gather the
documents' probabilities by grouped aggregation; a site's rate is shrunk toward its
parent's, the more the sparser the site, with a strength fitted to the spread between
sites.  The posterior adds the log odds of the path's rate, without the document itself,
to the document's evidence.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table, text_of

#: Labelled documents that the classifier is fitted on, features it keeps, and the chi-square they need.
FIT_DOCS, FEATURES, LEAST_CHI2 = 20_000, 20_000, 30.0
#: Leading bytes of a longer word that count as its stem.
STEM = 5
TARGETS = ("quality", "toxic")
#: Log odds are cut to this range, so that no site's prior outweighs clear evidence.
MOST = 12.0

_PUNCT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_CLASS = np.zeros(256, np.int64)
_CLASS[[*string.ascii_uppercase.encode()]] = 1
_CLASS[[*string.digits.encode()]] = 2
_CLASS[[*string.punctuation.encode()]] = 3
_CLASS[[*string.whitespace.encode()]] = 4


def features(text: bytes) -> set[bytes]:
    """Distinct words without ASCII punctuation and case, their stems, and bins of the text's shape (names with blanks)."""
    words = text.lower().translate(_PUNCT).split()
    distinct = set(words)
    out = distinct | {b"stem " + w[:STEM] for w in distinct if len(w) > STEM}
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=5)
    size = max(1, len(text))
    for name, part in zip((b"upper", b"digit", b"punct", b"space"), kinds[1:], strict=True):
        out.add(b"shape %s %d" % (name, min(9, int(20 * part / size))))
    out.add(b"shape length %d" % min(8, len(words).bit_length()))
    lines = text.split(b"\n")
    out.add(b"shape lines %d" % int(4 * len(set(lines)) / len(lines)))
    out.add(b"shape distinct %d" % int(10 * len(distinct) / max(1, len(words))))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, toxic, text) to how many documents of each target and class have a feature."""
    counts: Counter = Counter()
    for batch in batches:
        labels = [batch.column(i).to_pylist() for i in range(2)]
        for q, t, text in zip(*labels, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            found = features(text)
            found.add(b"shape all")
            for i, label in enumerate((q, t)):
                if label is not None:
                    counts.update((f, 2 * i + int(label > 0)) for f in found)
        if len(counts) > 1_000_000:
            yield _counted(counts)
            counts.clear()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.binary()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["feature", "cell", "n"])


def fit(docs: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS) -> tuple[list[float], dict[bytes, tuple[float, float]]]:
    """Prior log odds of each target, and log odds of the telling features.

    At most ``fit_docs`` labelled documents are used, those with the smallest hash of their
    id; labels without a document, and null labels, teach nothing.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    counts = joined.select("quality", "toxic", "text").mapInArrow(_count, "feature binary, cell int, n long")
    cells = [F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)]
    table_ = counts.groupBy("feature").agg(*cells)
    totals = table_.where(F.col("feature") == F.lit(b"shape all")).drop("feature").first()
    totals = [int(x) for x in totals] if totals else [0] * 4
    chi2 = []
    for i in (0, 2):
        a, b = F.col(f"n{i + 1}").cast("double"), F.col(f"n{i}").cast("double")
        c, d = totals[i + 1] - a, totals[i] - b
        n = float(totals[i] + totals[i + 1])
        bottom = (a + b) * (c + d) * float(totals[i + 1]) * float(totals[i])
        chi2.append(F.when(bottom > 0, n * (a * d - b * c) * (a * d - b * c) / bottom).otherwise(0.0))
    telling = table_.withColumn("q2", chi2[0]).withColumn("t2", chi2[1]).withColumn("best", F.greatest("q2", "t2"))
    telling = telling.where((F.col("best") >= LEAST_CHI2) & (F.col("feature") != F.lit(b"shape all")))
    telling = telling.orderBy(F.col("best").desc(), "feature").limit(FEATURES)  # the size of the model

    def odds(pos, neg, i):
        return math.log((pos + 0.5) / (totals[i + 1] + 1)) - math.log((neg + 0.5) / (totals[i] + 1))

    model = {}
    for r in telling.collect():
        model[bytes(r["feature"])] = tuple(odds(r[f"n{i + 1}"], r[f"n{i}"], i) if r[name] >= LEAST_CHI2 else 0.0 for i, name in ((0, "q2"), (2, "t2")))
    prior = [math.log((totals[i + 1] + 0.5) / (totals[i] + 0.5)) for i in (0, 2)]
    return prior, model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, model = shared.value
        known = model.keys()
        for batch in batches:
            scores: list[list[float]] = [[], []]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = [model[f] for f in features(text) & known]
                for i in range(2):
                    scores[i].append(max(-MOST, min(MOST, prior[i] + sum(x[i] for x in found))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), *(pa.array(s, pa.float64()) for s in scores)], names=["doc_id", "host", "path", "quality", "toxic"])

    return run


def _sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (F.lit(1.0) - p))


def _strength(sites: DataFrame, parent_rate, target: str) -> float:
    """Pseudo-documents of the parent's rate that a site starts with, by the method of moments.

    Between-site variance is what the sites' rates vary beyond sampling; m (1 - m) / that,
    less one, is the strength.
    """
    n, k = F.col("n").cast("double"), F.col(f"k_{target}")
    row = sites.where("n > 1").agg(
        F.sum(n * F.pow(k / n - parent_rate, 2)), F.sum(parent_rate * (1 - parent_rate)), F.sum(n), F.sum(n * parent_rate * (1 - parent_rate)),
    ).first()
    if not row[2]:
        return 10.0
    spread = max(1e-9, (row[0] - row[1]) / row[2])
    return float(min(1e6, max(1.0, (row[3] / row[2]) / spread - 1)))


def classify(docs: DataFrame, labels: DataFrame, *, host: str, path: str, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``doc_id, p_quality, p_toxic, kept`` for each row of ``docs(doc_id, text, host, path)``.

    ``kept`` is true where quality is likelier than not and toxicity isn't.  A null text is
    empty; a null host or path is a site of its own; null ids and repeated rows stay and are
    scored alike.  Without labels all rows get even odds for both and are kept.  An empty
    table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    shared = spark.sparkContext.broadcast(fit(docs, labels, fit_docs=fit_docs))
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), site(host).alias("host"), site(path).alias("path"))
    scored = ws.save(rows.mapInArrow(_score(shared), "doc_id long, host string, path string, quality double, toxic double"), "scored")

    sums = [F.count("*").alias("n"), *[F.sum(_sigmoid(F.col(t))).alias(f"k_{t}") for t in TARGETS]]
    paths = ws.save(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = ws.save(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *[f"k_{t}" for t in TARGETS])]), "hosts")
    total = hosts.agg(F.sum("n"), *[F.sum(f"k_{t}") for t in TARGETS]).first()
    rate = {t: (total[i + 1] / total[0] if total[0] else 0.5) for i, t in enumerate(TARGETS)}
    at_host = {t: _strength(hosts, F.lit(rate[t]), t) for t in TARGETS}
    shrunk = hosts.select("host", *[((F.col(f"k_{t}") + at_host[t] * rate[t]) / (F.col("n") + at_host[t])).alias(f"host_{t}") for t in TARGETS])
    paths = ws.save(paths.join(shrunk, "host"), "sites")
    at_path = {t: _strength(paths, F.col(f"host_{t}"), t) for t in TARGETS}

    known = scored.join(paths, ["host", "path"])
    out = []
    for t in TARGETS:
        others = (F.col(f"k_{t}") - _sigmoid(F.col(t)) + at_path[t] * F.col(f"host_{t}")) / (F.col("n") - 1 + at_path[t])
        out.append(_sigmoid(F.col(t) + _logit(others) - _logit(F.lit(rate[t]))).alias(f"p_{t}"))
    return known.select("doc_id", *out).withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") <= 0.5))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    return classify(docs, table(spark, sf_dir, "labels"), host="host", path="path")
