"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one of ordinary windows, trained by zstandard's own cover
search, and one that holds in addition the wording that sets toxic texts apart. A window of a text that is compressed
with both comes out shorter with the second only where it repeats such wording. A document is described by how many of
its windows save how many bytes, and a logistic curve over these figures, fitted on documents whose windows the
dictionaries had not seen, turns them into a score.

Training reads a bounded sample of labelled rows (``PER_CLASS`` of each label, in the order of a hash of the id, none
longer than ``LONGEST`` bytes); scoring is a map over all whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import words

#: Labelled documents of each class that training reads, and the most bytes of one.
PER_CLASS, LONGEST = 3000, 20_000
WINDOW_WORDS = 12
ORDINARY_BYTES, TOXIC_BYTES = 26_000, 4096
LEVEL = 9
#: Least share of the toxic texts that hold a telling piece, and how many times the ordinary share that must be.
LEAST_SHARE, LEAST_RATIO = 0.02, 15.0
#: Bytes that a window must save to count, one figure each.
SAVINGS = (2, 4, 6)


@dataclass
class ToxicityModel:
    """All that scoring needs; a few ten thousand bytes."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Callable[[bytes], float]:
        measure = _measure(self.ordinary, self.toxic)

        def score(text: bytes) -> float:
            x = np.append((measure(text) - self.mean) / self.scale, 1.0) @ self.weights
            return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

        return score


def windows(text: bytes) -> list[bytes]:
    tokens = words(text)
    return [b" ".join(tokens[i : i + WINDOW_WORDS]) for i in range(0, len(tokens), WINDOW_WORDS)] or [b""]


def _compressor(content: bytes) -> Callable[[bytes], bytes]:
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def _measure(ordinary: bytes, toxic: bytes) -> Callable[[bytes], np.ndarray]:
    plain, sharp = _compressor(ordinary), _compressor(toxic)

    def measure(text: bytes) -> np.ndarray:
        saved = np.array([len(plain(w)) - len(sharp(w)) for w in windows(text)], dtype=float)
        best = np.sort(saved)[::-1]
        over = [saved >= s for s in SAVINGS]
        return np.array([best[0], best[:3].mean(), saved.mean(), *(np.log1p(o.sum()) for o in over), *(o.mean() for o in over), np.log(len(saved))])

    return measure


def pieces(text: bytes) -> set[bytes]:
    """Words of a text and their beginnings, with the space before them."""
    out = set()
    for word in set(words(text)):
        out.add(b" " + word + b" ")
        out.update(b" " + word[:n] for n in range(5, min(len(word), 10)))
    return out


def telling_pieces(texts: list[bytes], labels: list[int], limit: int) -> list[bytes]:
    """Wording that far more toxic than ordinary texts hold, the strongest last, within ``limit`` bytes.

    A piece must occur in ``LEAST_SHARE`` of the toxic texts, so that chance finds do not grow with the sample, and may not
    hold a stronger one.
    """
    held, totals = (Counter(), Counter()), [1, 1]
    for text, label in zip(texts, labels):
        held[label].update(pieces(text))
        totals[label] += 1
    strength = {}
    for piece, n in held[1].items():
        if n >= max(3, LEAST_SHARE * totals[1]):
            ratio = n / totals[1] / ((held[0][piece] + 1) / totals[0])
            if ratio >= LEAST_RATIO:
                strength[piece] = n * np.log(ratio) * min(len(piece), 9)
    chosen: list[bytes] = []
    used = 0
    for piece in sorted(strength, key=lambda w: (-strength[w], w)):
        if any(c.strip() in piece for c in chosen):
            continue
        used += len(piece)
        if used > limit:
            break
        chosen.append(piece)
    return chosen[::-1]


def dictionaries(texts: list[bytes], labels: list[int]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    import zstandard

    samples = [w for text, label in zip(texts, labels) if not label for w in windows(text)]
    samples = samples[:: max(1, len(samples) // 60_000)]
    try:
        ordinary = zstandard.train_dictionary(ORDINARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text for the search
        ordinary = b" ".join(samples)[-ORDINARY_BYTES:] or b" "
    return ordinary, b"".join(telling_pieces(texts, labels, TOXIC_BYTES)) + b" " + ordinary


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve, the last for the constant column, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w, hold = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    hold[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = weight * (p * (1 - p) + 1e-6)
        w = w + np.linalg.solve((x.T * curve) @ x + hold, x.T @ (weight * (y - p)) - hold @ w)
    return w


def train(texts: list[bytes], labels: list[int], prior: tuple[int, int]) -> ToxicityModel:
    """Fit on labelled texts. ``prior``: how many labelled rows there are of each class, sampled or not.

    Without any text of one class the score of every document is the share of toxic rows.
    """
    pairs = list(dict(zip(texts, labels)).items())  # repeated texts count once
    texts, labels = [t for t, _ in pairs], [n for _, n in pairs]
    share = (prior[1] + 1) / (sum(prior) + 2)
    if len(set(labels)) < 2:
        size = 4 + 2 * len(SAVINGS)
        return ToxicityModel(b" ", b"  ", np.zeros(size), np.ones(size), np.append(np.zeros(size), np.log(share / (1 - share))))
    y = np.array(labels, dtype=float)
    half = np.array([crc32(t) % 2 for t in texts])
    x = np.zeros((len(texts), 4 + 2 * len(SAVINGS)))
    for h in (0, 1):  # each half is measured with dictionaries of the other
        seen = np.flatnonzero(half != h)
        measure = _measure(*dictionaries([texts[i] for i in seen], [labels[i] for i in seen]))
        for i in np.flatnonzero(half == h):
            x[i] = measure(texts[i])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    ordinary, toxic = dictionaries(texts, labels)
    return ToxicityModel(ordinary, toxic, mean, scale, fit_logistic((x - mean) / scale, y, weight))


def learn(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> ToxicityModel:
    """Train on ``labels`` (doc_id, toxic) joined with the texts; rows with a null id, label or text are left out.

    An id with several labels counts as toxic if one of them does.
    """
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts, kinds = [], []
    for kind in (0, 1):
        chosen = marked.filter(F.col("toxic") == kind).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        found = documents.select("doc_id", "text").filter(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id", "left_semi")
        got = sorted(row["text"].encode() for row in found.dropDuplicates(["doc_id"]).limit(per_class).select("text").collect())
        texts += got
        kinds += [kind] * len(got)
    return train(texts, kinds, (counts.get(0, 0), counts.get(1, 0)))


def score_toxicity(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= threshold) for every whole text.

    Null and empty texts are one empty window and get the score that goes with it. Repeated rows give repeated results;
    null ids are kept; other columns are left out; an empty table gives no rows.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in batches:
            scores = pa.array([score(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=[id_col, "score"])

    scored = documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
