"""An index of vectors by cells, for nearest neighbours of one or many questions without reading all rows.

Centres are fitted on a bounded sample; every row is stored under the cell of its nearest centre, with its distance from it (its
residual). A search reads the cells whose centres are nearest to a question. The exact mode goes on: a cell is read unless the
triangle inequality says that it holds nothing nearer than what has been found (distance to the centre less the cell's radius),
and so is, inside a cell, a row by its residual. Distances are between vectors at length one, so they rank like cosine similarity.

A cell's rows and the questions that read it meet in groups of a bounded number of rows and questions, however many there are of either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from math import isqrt
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine_similarity, l2_normalize, literal
from lectern.sources.scratch import stored

#: Most cells of an index; their centres are sent to every task. A cell of fewer rows than CELL_ROWS is not worth a file.
MAX_CELLS, CELL_ROWS = 4096, 1024
#: Rows for each cell that the centres are fitted on, chosen by a hash of their ids: at most MAX_CELLS times as many.
SAMPLE = 64
#: Bytes of vectors in a file of the index.
FILE_BYTES = 128 << 20
#: Rows of a cell and questions that are compared in one group.
ROW_BLOCK, ASKED_BLOCK = 1 << 14, 512
#: Numbers of one matrix of products or distances, so that what a task holds grows neither with cells, nor with rows or questions.
AT_ONCE = 1 << 20
#: Cells of a question whose distances are told to the scan one by one.
RINGS = 64
#: Room that bounds leave for rounding.
SLACK = 1e-7
#: Deviations that the likely mode allows for.
SURE = 3.0
CELLS = "cell int, centre array<double>, radius double, typical double, spread double, rows long"
#: Digits of a similarity that count: products of matrices differ in the last ones by where a row stands.
DIGITS = 12


@dataclass(frozen=True)
class Map:
    """The cells of an index: their centres, their largest and typical residuals, and how far angles at their centres stray from a right one."""

    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    typical: np.ndarray
    spread: np.ndarray

    def touched(self, gaps: np.ndarray, reach: np.ndarray, sure: float | None) -> np.ndarray:
        """Which cells may hold a row within each question's reach, by the triangle inequality; with sure, those that likely do.

        A row at its typical residual r from a centre that is g away lies within reach if the angle between both is
        small enough: its cosine must be (g^2 + r^2 - reach^2) / 2gr. Cosines stray about zero, so few go beyond sure deviations.
        """
        reach = reach[:, None]
        held = gaps - self.radius <= reach + SLACK
        if sure is not None:
            needed = gaps**2 + self.typical**2 - reach**2
            held &= needed <= sure * self.spread * 2 * gaps * self.typical + SLACK
        return held


@dataclass(frozen=True)
class VectorIndex:
    """A written index: rows (cell, id, residual, lean, vector) in a folder for each cell, and a row of figures for each cell."""

    spark: SparkSession
    path: str
    id_type: str
    vector_type: str

    @cached_property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, residual double, lean double, vector {self.vector_type}, cell int").parquet(f"{self.path}/rows")

    @cached_property
    def cells(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")

    @cached_property
    def _map(self) -> Map | None:
        """The cells as arrays; MAX_CELLS rows at most."""
        found = sorted(self.cells.collect(), key=lambda r: r["cell"])
        return Map(np.array([r["cell"] for r in found]), *(np.array([r[c] for r in found], float) for c in ("centre", "radius", "typical", "spread"))) if found else None

    def search(self, asked: DataFrame, limit: int, probes: int = 4, exact: bool = False, sure: float = SURE, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, vector_similarity, vector_rank): the nearest rows of every row of asked (query_id, vector), ties by id.

        The probes nearest cells are read, and then those that may hold something nearer: surely (exact) or likely, by sure deviations of the
        angle at a cell's centre. allowed (id) limits the rows that may be found. Questions without a vector find nothing.
        """
        kind = asked.schema["query_id"].dataType.simpleString()
        questions = asked.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("reach"))
        if self._map is None or limit < 1:
            return self.spark.createDataFrame([], f"query_id {kind}, id {self.id_type}, vector_similarity double, vector_rank long")
        table = self.spark.sparkContext.broadcast(self._map)
        ddl = f"query_id {kind}, vector array<double>, cell int, gap double, reach double"
        near = stored(questions.mapInArrow(_nearest_cells(table, probes), ddl), "probes")
        found = stored(self._compared(near, limit, allowed), "found")
        best = found.groupBy("query_id").agg(F.sort_array(F.collect_list("vector_similarity"), asc=False).alias("s"))
        kth = F.try_element_at("s", F.lit(limit))  # a similarity of 0 stands for all rows that are no nearer, so it bounds nothing
        reach = best.select("query_id", F.when(kth > 0, F.sqrt(2 - 2 * F.least(kth, F.lit(1.0)))).alias("reach"))
        more = questions.drop("reach").join(reach, "query_id", "left").mapInArrow(_reached_cells(table, probes, None if exact else sure), ddl)
        found = found.unionByName(self._compared(stored(more, "probes"), limit, allowed))
        w = Window.partitionBy("query_id").orderBy(F.desc("vector_similarity"), "id")
        return found.withColumn("vector_rank", F.row_number().over(w).cast("long")).where(F.col("vector_rank") <= limit)

    def nearest(self, vector: list[float], limit: int, probes: int = 4, exact: bool = False, sure: float = SURE, allowed: DataFrame | None = None) -> DataFrame:
        """search for one question: one scan of its nearest cells, and one of the cells that its reach still touches."""
        cells, asked = self._map, np.array(vector, float)
        if cells is None or limit < 1:
            return self.spark.createDataFrame([], f"id {self.id_type}, vector_similarity double, vector_rank long")
        if cells.centre.shape[1] != len(asked):
            raise ValueError(f"the question has {len(asked)} and the index {cells.centre.shape[1]} dimensions")
        length = np.linalg.norm(asked)
        gaps = np.linalg.norm(cells.centre - (asked / length if length else asked), axis=1)
        near = _nearest(gaps[None, :], probes)[0]
        hits = self._scan(F.col("cell").isin(cells.cell[near].tolist()), vector, limit, allowed)
        kth = hits[-1][1] if len(hits) == limit else 0.0
        reach = np.sqrt(2 - 2 * min(kth, 1.0)) + SLACK if kth > 0 else np.inf  # a similarity of 0 stands for all rows that are no nearer
        more = np.flatnonzero(cells.touched(gaps[None, :], np.array([reach]), None if exact else sure)[0] & ~near)
        touched = F.col("cell").isin(cells.cell[more].tolist())
        if len(more) <= RINGS and np.isfinite(reach):  # told to the scan of each cell: only rows at some distances from its centre
            touched = reduce(or_, ((F.col("cell") == int(cells.cell[k])) & F.col("residual").between(float(gaps[k] - reach), float(gaps[k] + reach)) for k in more), F.lit(False))
        if len(more):
            hits = sorted(hits + self._scan(touched, vector, limit, allowed), key=lambda x: (-x[1], x[0]))[:limit]
        rows = [(i, s, n) for n, (i, s) in enumerate(hits, 1)]
        return self.spark.createDataFrame(rows, f"id {self.id_type}, vector_similarity double, vector_rank long")

    def _scan(self, where: Column, vector: list[float], limit: int, allowed: DataFrame | None) -> list[tuple]:
        rows = self.rows.where(where)
        if allowed is not None:
            rows = rows.join(allowed.select("id"), "id", "left_semi")
        scored = rows.select("id", cosine_similarity(F.col("vector"), literal(vector)).alias("s"))
        return [tuple(r) for r in scored.orderBy(F.desc("s"), "id").limit(limit).collect()]

    def _compared(self, probes: DataFrame, limit: int, allowed: DataFrame | None) -> DataFrame:
        """Each group's best limit rows of each of its questions."""
        asked = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MAX_CELLS rows at most
        rows = self.rows.where(F.col("cell").isin(list(asked)))  # only these folders are read
        if allowed is not None:
            rows = rows.join(allowed.select("id"), "id", "left_semi")
        sizes = self.cells.select("cell", F.ceil(F.col("rows") / ROW_BLOCK).cast("int").alias("parts"))
        sizes = sizes.join(probes.groupBy("cell").agg(F.ceil(F.count("*") / ASKED_BLOCK).cast("int").alias("sides")), "cell")
        bounded = F.broadcast(sizes)  # MAX_CELLS rows at most
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = rows.join(bounded, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), upto("sides").alias("side"), "id", "residual", "vector")
        right = probes.join(bounded, "cell").select("cell", upto("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "sides").cast("int").alias("side"), "query_id", F.col("vector").alias("asked"), "gap", "reach")
        ddl = f"query_id {probes.schema['query_id'].dataType.simpleString()}, id {self.id_type}, vector_similarity double"
        key = ["cell", "part", "side"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(limit), ddl)


def build_vector_index(chunks: DataFrame, path: str, id_col: str = "id", embedding_col: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Index every row that has a vector. Cells: by default one for each CELL_ROWS rows, at most the square root of their number and MAX_CELLS.

    All vectors have the same number of dimensions, else it raises; one of length zero has no direction and is like nothing.
    """
    spark = chunks.sparkSession
    vectors = chunks.where(F.col(embedding_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(embedding_col).alias("vector"))
    count, least, dims = vectors.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != dims:
        raise ValueError(f"vectors have from {least} to {dims} dimensions")
    centres = spark.sparkContext.broadcast(fitted_centres(vectors, min(cells or min(isqrt(count), max(1, count // CELL_ROWS)), MAX_CELLS, count))) if count else None
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    index = VectorIndex(spark, path, kinds["id"], kinds["vector"])
    placed = vectors.mapInArrow(_placed(centres), f"cell int, id {kinds['id']}, residual double, lean double, vector {kinds['vector']}")
    held_bytes = count * (dims or 0) * 4
    files = max(1, -(-held_bytes // FILE_BYTES), min(spark.sparkContext.defaultParallelism, held_bytes >> 20))
    # by residual too, so that a cell with very many rows goes to several tasks and files
    placed.repartitionByRange(files, "cell", "residual").sortWithinPartitions("cell", "residual").write.partitionBy("cell").parquet(f"{path}/rows")
    if not count:
        spark.createDataFrame([], CELLS).write.parquet(f"{path}/cells")
        return index
    where = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres.value)], "cell int, centre array<double>")
    held = index.rows.groupBy("cell").agg(F.max("residual").alias("radius"), F.avg("residual").alias("typical"), F.sqrt(F.avg(F.col("lean") * F.col("lean"))).alias("spread"), F.count("*").alias("rows"))
    where.join(held, "cell").coalesce(1).write.parquet(f"{path}/cells")
    return index


def fitted_centres(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres of cells, fitted on SAMPLE rows for each."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE).select(array_to_vector(l2_normalize(F.col("vector"))).alias("features")).persist()
    try:
        model = KMeans(k=cells, maxIter=8, seed=1, initMode="random").fit(sample) if cells > 1 else None
        return np.array(model.clusterCenters()) if model else np.array([sample.first()[0].toArray()])
    finally:
        sample.unpersist()


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows at length one; those of length zero stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), float)
    sizes = np.asarray(column.value_lengths())
    if (sizes != dims).any():
        raise ValueError(f"vectors have {sizes[sizes != dims][0]} and the index {dims} dimensions")
    out = flat.reshape(len(column), dims)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch in slices of AT_ONCE numbers at width for each row, a row at least, and where they begin."""
    rows = max(1, AT_ONCE // max(1, width))
    for at in range(0, batch.num_rows, rows):
        yield at, batch.slice(at, rows)


def _placed(centres):
    """Rows with the cell of the nearest centre, their distance from it, and the cosine at it between the row and another centre, taken in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in (x for b in batches if b.num_rows for x in _slices(b, len(centres.value))):
            where = centres.value
            vectors = _matrix(batch.column("vector"), where.shape[1])
            cell = _distances(vectors, where).argmin(1)
            away, across = vectors - where[cell], where[(cell + 1 + np.arange(at, at + len(cell)) % max(1, len(where) - 1)) % len(where)] - where[cell]
            residual = np.linalg.norm(away, axis=1)
            scale = residual * np.linalg.norm(across, axis=1)
            lean = np.divide((away * across).sum(1), scale, out=np.zeros(len(cell)), where=scale > 0)
            columns = [pa.array(cell, pa.int32()), batch.column("id"), pa.array(residual), pa.array(lean), batch.column("vector")]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "id", "residual", "lean", "vector"])

    return run


def _probed(batch: pa.RecordBatch, cells: np.ndarray, gaps: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
    who, which = np.nonzero(chosen)
    take = pa.array(who)
    columns = [batch.column("query_id").take(take), batch.column("vector").take(take), pa.array(cells[which], pa.int32()), pa.array(gaps[who, which]), batch.column("reach").take(take)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vector", "cell", "gap", "reach"])


def _nearest(gaps: np.ndarray, probes: int) -> np.ndarray:
    """Marks the probes nearest cells of each question."""
    order = np.argsort(gaps, axis=1, kind="stable")[:, :probes]
    chosen = np.zeros(gaps.shape, bool)
    np.put_along_axis(chosen, order, True, 1)
    return chosen


def _nearest_cells(table, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = table.value
        for _, batch in (x for b in batches for x in _slices(b, len(cells.cell))):
            gaps = _distances(_matrix(batch.column("vector"), cells.centre.shape[1]), cells.centre)
            yield _probed(batch, cells.cell, gaps, _nearest(gaps, probes))

    return run


def _reached_cells(table, probes: int, sure: float | None):
    """The cells beyond the probes nearest that may hold a row within reach (any cell where reach is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = table.value
        for _, batch in (x for b in batches for x in _slices(b, len(cells.cell))):
            gaps = _distances(_matrix(batch.column("vector"), cells.centre.shape[1]), cells.centre)
            reach = np.asarray(batch.column("reach").fill_null(np.inf), float)
            yield _probed(batch, cells.cell, gaps, cells.touched(gaps, reach, sure) & ~_nearest(gaps, probes))

    return run


def _best(limit: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "id", "vector_similarity"]
        if not rows.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([asked.column("query_id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64())], names)
        gap, reach = np.asarray(asked.column("gap")), np.asarray(asked.column("reach").fill_null(np.inf), float)
        residual = np.asarray(rows.column("residual"))
        near = (residual >= (gap - reach).min() - SLACK) & (residual <= (gap + reach).max() + SLACK)
        rows = rows.filter(pa.array(near))
        questions = asked.column("asked").combine_chunks()
        dims = len(questions[0])
        unit, ids = _matrix(questions, dims), rows.column("id").to_numpy()
        who, which, found = [], [], []
        for start, part in _slices(rows, len(unit)):
            value = unit @ _matrix(part.column("vector"), dims).T
            np.round(np.maximum(0.0, value, out=value), DIGITS, out=value)
            for k, row in enumerate(value):
                at = np.flatnonzero(row >= np.partition(row, len(row) - limit)[len(row) - limit]) if len(row) > limit else np.arange(len(row))
                at = at[np.lexsort((ids[start + at], -row[at]))][:limit]
                which.append(start + at)
                who.append(np.full(len(at), k))
                found.append(row[at])
        who, which, found = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((who, int), (which, int), (found, float)))
        order = np.lexsort((ids[which], -found, who))  # the best of all slices
        who, which, found = who[order], which[order], found[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < limit
        return pa.Table.from_arrays([asked.column("query_id").take(pa.array(who[kept])), rows.column("id").take(pa.array(which[kept])), pa.array(found[kept])], names)

    return run


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, recall): the share of wanted (query_id, id) that found has."""
    hits = wanted.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(reduce(lambda a, b: a / b, (F.count("hit"), F.count("*"))).alias("recall"))
