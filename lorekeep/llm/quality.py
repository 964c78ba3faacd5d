"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier reads the shape of each text (shares of letter cases, digits and marks, repeated words and lines).
Its probabilities, and labels where there are any, are summed by host and by path below it. Each level's rate is shrunk
towards the level above it, by a strength that is estimated from how far sites differ beyond what chance explains: a
site with few documents stays near the global rate. The posterior of a document joins its own evidence with the odds
of its path. All sums are grouped aggregations with partial sums before the shuffle; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import fresh, stored
from lorekeep.llm.toxicity import fit_logistic

#: Labelled documents that the classifier is fitted on at most, in the order of a hash of the id.
TRAINING_ROWS = 20_000
MARKS = b"|!#$%&*=~_^<>{}[]@/\\.,;:?-"
EDGE = 1e-4


def features(text: bytes) -> np.ndarray:
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    tokens = text.lower().split()
    lines = text.split(b"\n")
    words = max(1, len(tokens))
    doubled = 1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines)))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    return np.array(
        [
            np.log1p(len(text)), upper, lower, upper / (upper + lower + EDGE), counts[48:58].sum(), counts[128:].sum(), counts[10], counts[32],
            len(set(tokens)) / words, np.log1p(len(tokens)), n / words, doubled, len(lines) / words, float(not tokens),
            *np.sqrt(counts[list(MARKS)]),
        ]
    )


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -9, 9)))


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Without labels of both kinds every document gets the same probability."""
    if len(set(y.tolist())) < 2:
        size = len(features(b""))
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(size), np.ones(size), np.append(np.zeros(size), np.log(share / (1 - share))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    return QualityModel(mean, scale, fit_logistic(np.clip((x - mean) / scale, -8, 8), y.astype(float), np.ones(len(y)), ridge=2.0))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, good (0/1): rows with nulls are left out; an id with several labels is good if all are."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> QualityModel:
    """Fit the classifier on at most ``rows`` labelled documents; only their figures reach the driver."""
    chosen = known_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = [features(t.as_py() or b"").tolist() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(figures, pa.list_(pa.float64()))], names=["good", "x"])

    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    got = labelled.select("good", "text").mapInArrow(run, "good int, x array<double>").limit(rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(features(b"")))), np.zeros(0))
    x = np.array(got["x"].tolist())
    order = np.lexsort(x.T)  # the order of rows in a sum does not depend on tasks
    return fit(x[order], got["good"].to_numpy()[order])


def classify(documents: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """The classifier's probability of a text as a column."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(sent.value.probability(np.array([features((t or "").encode()) for t in texts])))

    return probability(F.col(text_col))


def logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(held / (1 - held))


def strength(groups: DataFrame, total: str, good: str, mean: str) -> float:
    """Pseudo-documents that the level above weighs, by moments of the group rates around ``mean``."""
    rate = F.col(good) / F.col(total)
    m = groups.agg(
        F.sum(F.col(total) * (rate - F.col(mean)) ** 2).alias("spread"),
        F.sum(F.col(mean) * (1 - F.col(mean))).alias("chance"),
        F.sum(total).alias("n"),
        F.sum(F.col(total) ** 2).alias("n2"),
        F.count("*").alias("groups"),
    ).first()
    if not m["n"] or m["groups"] < 2 or m["n"] == m["n2"] / m["n"]:
        return 10.0
    between = max(1e-5, (m["spread"] - m["chance"]) / (m["n"] - m["n2"] / m["n"]))
    return float(np.clip(m["chance"] / m["groups"] / between - 1, 2.0, 1000.0))


def site_rates(evidence: DataFrame) -> DataFrame:
    """(host, path, good) rows -> host, path, global_rate, host_rate, path_rate.

    The table has one row per path; it is written to the shared folder, so that the planner knows its size.
    """
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s")), "quality-sites")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = ((whole["s"] or 0) + 1) / ((whole["n"] or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")).withColumn("global_rate", F.lit(rate))
    k = strength(hosts, "hn", "hs", "global_rate")
    hosts = hosts.withColumn("host_rate", (F.col("hs") + k * F.col("global_rate")) / (F.col("hn") + k))
    below = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "path", "n", "s", "global_rate", "host_rate")
    k2 = strength(below, "n", "s", "host_rate")
    rates = below.withColumn("path_rate", (F.col("s") + k2 * F.col("host_rate")) / (F.col("n") + k2))
    return stored(rates.select("host", "path", "global_rate", "host_rate", "path_rate"), "quality-rates")


def judge(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, model: QualityModel | None = None) -> DataFrame:
    """All columns of ``documents`` plus doc_rate (the classifier), site_rate (its path), quality (posterior), keep.

    A null or empty text is judged by its figures like any other; null hosts and paths are groups of their own; labels of
    documents that are not there are left out; repeated rows give repeated results; without labels all documents get the
    same evidence; an empty table gives no rows. Columns of the input with the names of new ones are replaced.
    """
    model = model or learn(documents, labels)
    new = ["doc_rate", "site_rate", "quality", "keep"]
    kept = documents.drop(*new)
    scored = kept.withColumn("doc_rate", classify(kept, model))
    label_id, site, section, overall = fresh(scored, "_label_id", "_site", "_section", "_overall")
    known = known_labels(labels).select(F.col("doc_id").alias(label_id), "good")
    evidence = (
        scored.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "doc_rate")
        .join(known, F.col("doc_id") == F.col(label_id), "left")
        .select("host", "path", F.coalesce(F.col("good").cast("double"), "doc_rate").alias("good"))
    )
    rates = site_rates(evidence).select(F.col("host").alias(site), F.col("path").alias(section), F.col("global_rate").alias(overall), F.col("path_rate").alias("site_rate"))
    joined = scored.join(rates, F.col(host).eqNullSafe(F.col(site)) & F.col(path).eqNullSafe(F.col(section)), "left")
    odds = logit(F.col("doc_rate")) + logit(F.col("site_rate")) - logit(F.col(overall))
    quality = 1 / (1 + F.exp(-odds))
    return joined.withColumn("quality", quality).withColumn("keep", F.col("quality") >= threshold).drop(site, section, overall)
