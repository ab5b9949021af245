"""Quality scores by voting of nearest neighbours among labelled latent-semantic vectors.

The terms of a text are its pairs of neighbouring characters, of any script, hashed; the share of words that repeat the word before
them; and the share of distinct words. Square roots of the terms' shares, less their mean over labelled texts, are projected on the leading singular vectors of
the labelled texts' matrix. The labelled vectors, a bounded number, are broadcast. Each document's cosine with every
labelled vector is computed exactly, in blocks of matrix products; the nearest vote with weights that grow with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkset.llm.shared import keep, map_arrow, own_column, read_table, read_texts, slices

#: Labelled ids that fit the model; beyond it, those with the smallest hashes, whatever their labels, so that shares of labels stay true.
MOST_LABELLED = 4000
DIMENSIONS = 48
NEIGHBOURS = 25
#: A neighbour's weight is its similarity to this power.
SHARPNESS = 6
THRESHOLD = 0.3


#: Pairs are hashed to so many terms; added are words that repeat the word before, and distinct words.
PAIRS = 1021
TERMS = PAIRS + 2
_FACTOR = 0x9E3779B1


def _character_classes() -> np.ndarray:
    """Class of each code point of the first plane: capitals of ASCII, digits and kinds of white space are one each; others are themselves."""
    classes = np.arange(1 << 16, dtype=np.uint32)
    classes[ord("A") : ord("Z") + 1] = 1
    classes[ord("0") : ord("9") + 1] = 2
    classes[[ord(c) for c in "\n\r"]] = 3
    classes[[ord(c) for c in " \t"]] = 4
    return classes


_CLASSES = _character_classes()


def pair_terms(text: str) -> np.ndarray:
    """How often each hashed pair of neighbouring characters occurs."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _CLASSES[points] if len(points) and points.max() < 1 << 16 else np.where(points < 1 << 16, _CLASSES[points & 0xFFFF], points)
    return np.bincount((c[:-1] * np.uint32(_FACTOR) + c[1:]) % np.uint32(PAIRS), minlength=PAIRS)


def term_shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's terms; all zero where it is empty."""
    text = text or ""
    out = np.zeros(TERMS, np.float32)
    if len(text) > 1:
        out[:-2] = np.sqrt(pair_terms(text) / (len(text) - 1))
    words = text.encode("utf-8", "surrogatepass").split()
    if words:
        out[-2] = sum(map(eq, words, words[1:])) / len(words)
        out[-1] = 0.3 * len(set(words)) / len(words)
    return out


@dataclass
class Neighbours:
    """A fitted model: mean, projection, unit vectors of labelled texts and their labels."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @classmethod
    def fit(cls, shares: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Neighbours:
        if not len(shares):
            return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
        mean = shares.mean(0)
        centred = (shares - mean).astype(np.float64)
        values, axes = np.linalg.eigh(centred.T @ centred)  # its eigenvectors are the right singular vectors
        axes = axes[:, np.argsort(-values)[: min(dimensions, len(shares))]].astype(np.float32)
        model = cls(mean, axes, np.empty(0), labels.astype(np.float32), float(labels.mean()))
        model.vectors = model.project(shares)
        return model

    def project(self, shares: np.ndarray) -> np.ndarray:
        latent = (shares - self.mean) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, shares: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled texts; the prior where a text is empty or nothing is near."""
        if not len(self.vectors):
            return np.full(len(shares), self.prior)
        cosines = self.project(shares) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.vectors))
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** SHARPNESS
        total = weights.sum(1)
        votes = (weights * self.labels[nearest]).sum(1)
        return np.where((total > 0) & shares.any(1), np.divide(votes, total, out=np.zeros_like(votes), where=total > 0), self.prior)


def _shares_of(texts: pa.Array) -> np.ndarray:
    return np.stack([term_shares(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, TERMS), np.float32)


def fit(documents: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Neighbours:
    """Fit on ``labelled`` (ids and labels 0 or 1; null ones don't count), at most ``most`` ids and labels.

    Where there are more, those with the smallest hashes of their ids are taken. Ids labelled both ways count both ways; ids
    without a document don't count, and of several documents with one id one counts.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    chosen = F.broadcast(keep(rows.orderBy(F.xxhash64("id"), "id", "label").limit(most)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.tobytes() for x in _shares_of(batch.column(2))], pa.binary())], names=["id", "label", "shares"])

    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("id", "label", "text")
    kind = texts.schema["id"].dataType.simpleString()
    found = map_arrow(texts, run, f"id {kind}, label int, shares binary").groupBy("id", "label").agg(F.min("shares").alias("shares")).select("label", "shares").toArrow()
    shares = np.frombuffer(b"".join(x.as_py() for x in found.column("shares")), np.float32).reshape(-1, TERMS)
    order = np.lexsort((*shares.T[::97], found.column("label").to_numpy())) if len(shares) else []
    return Neighbours.fit(shares[order], found.column("label").to_numpy()[order].astype(np.float64))


def score(documents: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``documents`` with ``score_col``, a double from 0 to 1: the higher, the likelier label 1.

    Whole texts are scored; null and empty ones get the labelled texts' share of label 1. Rows repeat as in the input, null ids are
    carried along, and a column named like the new one is replaced. The model's size does not depend on the input.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in documents.columns if c.lower() != score_col.lower()]
    text, out = own_column(documents, "text_"), documents.select(*[f"`{c}`" for c in carried])
    schema = out.select("*", F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            made = shared.value.score(_shares_of(part.column(part.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.float64())], names=[*part.schema.names[:-1], score_col])

    return map_arrow(out.select("*", F.col(f"`{text_col}`").cast("string").alias(text)), run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_quality_knn(spark, sf_dir: str) -> DataFrame:
    """Score of all documents."""
    documents = read_texts(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, read_table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
