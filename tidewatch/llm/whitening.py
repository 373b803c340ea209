"""Whitening of embedding vectors by the singular values of centred rows.

Each entry c becomes the integer x = floor(scale * c) + shift. One pass sums the entries of all vectors exactly; a second gives MLlib's
`RowMatrix` the centred rows (n*x - S) / n, whose `computeSVD` adds up the Gram matrix over the executors, and adds up the exact
deviations, from which the total variance comes separately. A singular value s stands for the variance s^2 / n. The last pass projects
each centred vector on the components and divides by their deviations. All singular values are asked for, as MLlib then factors
the Gram matrix directly, without the tolerance of its iterative solver; what reaches the driver is one matrix of dimensions squared.

Defined cases: null vectors and vectors that hold null or non-finite entries take no part, nor do entries whose x is beyond 62 bits; the
dimension is the commonest length of the others (of equally common ones the greatest), and vectors of another length take no part;
an empty vector has no dimension. A null id is kept, repeated rows count each. Components without variance (a singular value below
1e-7 of the greatest) are left out, so one vector, equal vectors or an empty table give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Batches, tidy

#: Share of the greatest singular value below which a component counts as being without variance; the Gram matrix tells 1e-8 from nothing.
LEAST_SHARE = 1e-7
MOST_X = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """What all rows share: n vectors, their sums, and of each component the axis, the variance and its share of all variance."""

    scale: float
    shift: int
    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def _entries(vectors: pa.Array, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows that take part and a matrix of their x."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * flat[(ends[at] - length)[:, None] + np.arange(length)])
            fine = (np.abs(x) < MOST_X).all(axis=1)
        yield at[fine], x[fine].astype(np.int64) + shift


def _of_length(vectors: pa.Array, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    found = [(at, x) for at, x in _entries(vectors, w.scale, w.shift) if x.shape[1] == len(w.sums)]
    return found[0] if found else (np.zeros(0, np.int64), np.zeros((0, len(w.sums)), np.int64))


def _deviations(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, list[int]]:
    """n*x - S, and for each row the sum of its squares: in Python's integers where 64 bits could overflow."""
    sums = [int(s) for s in w.sums]
    reach = max((w.n * abs(int(v)) for v in (x.min(), x.max())), default=0) + max(map(abs, sums), default=0) if x.size else 0
    if reach * reach * max(len(sums), 1) < 1 << 63:
        d = w.n * x - w.sums
        return d.astype(np.float64), (d * d).sum(axis=1).tolist()
    d = w.n * x.astype(object) - np.array(sums, object)
    narrow = d if reach >= 1 << 63 else d.astype(np.int64)
    return d.astype(np.float64), [int(v) for v in ((narrow.astype(object)) ** 2).sum(axis=1)]


def sums_of(df: DataFrame, column: str, scale: float, shift: int) -> tuple[int, np.ndarray]:
    """How many vectors take part, and the sums of their x: each task sends one row a length."""

    def add(batches: Batches) -> Batches:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for at, x in _entries(batch.column(0), scale, shift):
                n, s = total.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                bound = int(np.abs(x).max(initial=0)) * len(x) < 1 << 63
                total[x.shape[1]] = (n + len(at), s + (x.sum(axis=0) if bound else x.astype(object).sum(axis=0)))
        keys = list(total)
        sums = [[Decimal(int(v)) for v in total[k][1]] for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], names=["length", "n", "sums"])

    parts = df.select(F.col(f"`{column}`").cast("array<double>").alias("v")).where("v is not null").mapInArrow(tidy(add), "length int, n long, sums array<decimal(38,0)>")
    spread = parts.where("n > 0").select("length", "n", F.posexplode("sums").alias("pos", "x"))
    each = spread.groupBy("length", "pos").agg(F.sum("n").alias("n"), F.sum("x").cast("decimal(38,0)").alias("x"))
    whole = each.groupBy("length").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("sums"))
    best = whole.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return (best[0].n, np.array([int(p.x) for p in best[0].sums], object)) if best else (0, np.zeros(0, object))


def centred(df: DataFrame, column: str, w: Whitening) -> DataFrame:
    """The centred vectors and their exact deviations."""

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            _, x = _of_length(batch.column(0), w)
            d, exact = _deviations(x, w)
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(w.sums), (d / w.n).ravel())
            yield pa.RecordBatch.from_arrays([flat, pa.array(map(Decimal, exact), pa.decimal128(38, 0))], names=["centred", "deviation"])

    return df.select(F.col(f"`{column}`").cast("array<double>").alias("v")).where("v is not null").mapInArrow(tidy(rows), "centred array<double>, deviation decimal(38,0)")


def fit(df: DataFrame, column: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """The whitening of all vectors that take part, or None where nothing varies."""
    n, sums = sums_of(df, column, scale, shift)
    if not n:
        return None
    sums = sums.astype(np.int64) if max(map(abs, sums)) < 1 << 63 else sums
    start = Whitening(scale, shift, n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), 0.0)
    rows = centred(df, column, start)
    total = Fraction(int(rows.agg(F.sum("deviation").alias("d")).first().d), n**3)  # the trace of the covariance, exact
    if not total:
        return None
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("centred").alias("row")), "row")
    svd = RowMatrix(vectors, n, len(sums)).computeSVD(len(sums), computeU=False, rCond=LEAST_SHARE)
    k = min(components, len(svd.s))
    variances = svd.s.toArray()[:k] ** 2 / n
    w = Whitening(scale, shift, n, sums, svd.V.toArray()[:, :k], variances, variances / float(total), 0.0)
    return Whitening(scale, shift, n, sums, w.axes, variances, w.explained, identity_error(df, column, w))


def _projected(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, list[int]]:
    d, exact = _deviations(x, w)
    return (d / w.n) @ w.axes / np.sqrt(w.variances), exact


def identity_error(df: DataFrame, column: str, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity. The vectors are centred before, so that sums
    of products and of the vectors, one row a task, lose nothing."""
    k = len(w.variances)

    def add(batches: Batches) -> Batches:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y, _ = _projected(_of_length(batch.column(0), w)[1], w)
            products += y.T @ y
            sums += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([[*products.ravel(), *sums]], pa.list_(pa.float64()))], names=["part"])

    parts = df.select(F.col(f"`{column}`").cast("array<double>").alias("v")).where("v is not null").mapInArrow(tidy(add), "part array<double>")
    total = dict(parts.select(F.posexplode("part").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect())
    flat = np.array([total[p] for p in range(k * k + k)])
    mean = flat[k * k :] / w.n
    return float(np.abs(flat[: k * k].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 8, id_column: str = "vec_id", column: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """For each vector that takes part and each component (from 1, by falling variance): the id, n, the exact deviation (the sum over
    dimensions of (n*x - S)^2), the whitened coordinate, the component's share of the total variance, and the identity error."""
    kind = df.select(F.col(f"`{id_column}`").alias(id_column)).schema[0]
    w = fit(df, column, components, scale, shift)
    schema = T.StructType([T.StructField(id_column, kind.dataType), *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")])
    if w is None:
        return df.sparkSession.createDataFrame([], schema)
    k = len(w.variances)

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            at, x = _of_length(batch.column(1), w)
            y, exact = _projected(x, w)
            ids = batch.column(0).take(pa.array(np.repeat(at, k)))
            deviations = pa.array(map(Decimal, exact), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), deviations, pa.array(y.ravel()), pa.array(np.tile(w.explained, len(at)))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "component", "deviation", "whitened", "explained"])

    flat = df.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{column}`").cast("array<double>").alias("v")).where("v is not null")
    out = T.StructType([f for f in schema if f.name not in ("n", "identity_error")])
    return flat.mapInArrow(tidy(rows), out).withColumns({"n": F.lit(w.n).cast("long"), "identity_error": F.lit(w.identity_error)}).select(*schema.names)
