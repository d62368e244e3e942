"""Text quality by naive Bayes support vectors (Wang and Manning, 2012).

Features are the byte n-grams of one to three bytes that occur in the whole text. Each indicator is scaled by the log ratio of
its shares among good and bad training texts; a linear hinge-loss model over the scaled, unit-length rows is
fitted by dual coordinate descent. Only a bounded sample of labelled rows reaches the driver, as features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.linear import fit_hinge, fit_sigmoid
from lectern.llm.texts import arrow, schema_of, steps, utf8

_TRIGRAM_BITS = 17
DIMS = (1 << _TRIGRAM_BITS) + (1 << 16) + (1 << 8)


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Grams:
    """Finds the distinct n-grams of texts; holds one flag for each feature."""

    def __init__(self) -> None:
        self.flags = np.zeros(DIMS, bool)

    def __call__(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:]
        three = ((two[:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - _TRIGRAM_BITS)
        self.flags[three] = True
        self.flags[two + np.uint32(1 << _TRIGRAM_BITS)] = True
        self.flags[b + np.uint32((1 << _TRIGRAM_BITS) + (1 << 16))] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


class QualityModel:
    """Fitted on (n-grams, label) pairs; label 1 is good."""

    def __init__(self, rows: list[tuple[np.ndarray, int]], smoothing: float = 1.0, c: float = 1.0):
        labels = np.array([1 if y else -1 for _, y in rows])
        counts = {s: np.full(DIMS, smoothing) for s in (1, -1)}
        for (grams, _), s in zip(rows, labels):
            counts[s][grams] += 1
        totals = {s: 2 * smoothing + (labels == s).sum() for s in (1, -1)}
        ratio = np.log(counts[1] / totals[1]) - np.log(counts[-1] / totals[-1])
        self.ratio = ratio.astype(np.float32)
        scaled = [(g, self._unit(g)) for g, _ in rows]
        self.weights = fit_hinge(scaled, labels, DIMS, c).astype(np.float32) if len(set(labels)) == 2 else np.zeros(DIMS, np.float32)
        margins = np.array([self.weights[g] @ v for g, v in scaled]) if rows else np.zeros(0)
        self.slope, self.offset = fit_sigmoid(margins, labels) if len(set(labels)) == 2 else (0.0, 0.0)

    def _unit(self, grams: np.ndarray) -> np.ndarray:
        values = self.ratio[grams]
        return values / max(float(np.sqrt(values @ values)), 1e-6)

    def score(self, grams: np.ndarray) -> float:
        margin = float(self.weights[grams] @ self._unit(grams)) if len(grams) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _features(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for step in steps(batch, "text"):
                found = [grams(x).astype(np.int32).tobytes() for x in utf8(step.column("text"))]
                yield arrow(schema, grams=found, label=step.column("label"))

    return run


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500) -> QualityModel:
    """Fit on the labelled rows that are not held out, about per_class of each class: those whose id hashes lowest.

    Labels other than 0 and 1 and null ids teach nothing; of several labels of one id the least counts; rows that repeat an id teach as
    often as they occur; null and empty texts have no feature; of one class alone, or of an empty table, nothing is learnt and
    scores are 0.5.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    marked = marked.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, per_class / max(1, sizes.get(1, 0))).otherwise(per_class / max(1, sizes.get(0, 0)))
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id").select("text", "label")
    found = "grams binary, label int"
    rows = sorted(texts.mapInArrow(_features(schema_of(spark, found)), found).collect(), key=tuple)  # whatever the split of files
    return QualityModel([(np.frombuffer(r["grams"], np.int32), r["label"]) for r in rows])


def _score(model: Broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for step in steps(batch, "text"):
                scores = [model.value.score(grams(x)) for x in utf8(step.column("text"))]
                yield arrow(schema, doc_id=step.column("doc_id"), held_out=step.column("held_out"), score=scores)

    return run


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher is better), predicted (1 from 0.5 on).

    Null and empty texts have no n-gram and get the score of a margin of zero; very long texts are scored whole, with a flag
    for each feature in memory; a score of just 0.5 is predicted 1; repeated rows are scored each; an empty table gives no rows; other
    columns of docs, whatever their names, are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    out = own.select("doc_id", "held_out", F.lit(0.0).cast("double").alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_score(sent, to_arrow_schema(out)), out).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
