"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries are put on a lattice, x = floor(1024 * c) + OFFSET, so counts and sums are exact. Rows are packed once into blocks of about
BLOCK_BYTES, written as Parquet; each step reads the blocks and makes both products, p = Xv and X'p, in one pass that
sends a sum for each dimension on. The driver keeps vectors as long as a row and no others: a left vector u is always X times such a
vector w, so products with earlier u come from w and X'p. Left and right vectors are made orthogonal to all earlier ones,
twice. Steps end when the leading singular triplets have converged to rounding, when the rows are exhausted, or at the number of
dimensions; after a breakdown they go on from a new vector of the row space, so repeated singular values are found too. The singular
value decomposition of the small bidiagonal matrix gives components and deviations.

Rows whose vector is null, or holds null, NaN or infinite entries, take no part; nor do those with entries of 2**42 or more, which have
no exact lattice value, nor those whose number of entries is not the most usual one (the smaller of two that tie). Null keys and repeated rows
stay rows. Components without variance (to rounding) are left out: an empty table, equal rows or empty vectors give no rows.
Other columns are left out. Signs of components are such that the largest entry (the first of equal ones) is positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.common import saved, tidy

SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**42
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 2048
EPS = float(np.finfo(float).eps)
#: A length that is smaller than the largest by this factor is none.
NOTHING = 1e-11


def packed(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Blocks (ids; data: little-endian integers, a row after another; wide: they have 64 bits, else 32) of lattice values without OFFSET, and the number of dimensions."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LARGEST)))
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = usual["dims"] if usual else 0
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 4 * dims)))
    kind = rows.schema["id"].dataType
    ids_type = pa.list_(to_arrow_type(kind))

    def block(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        wide = bool(np.abs(x).max(initial=0) >= 2**31)
        ids = pa.concat_arrays(ids)
        return pa.record_batch([pa.ListArray.from_arrays([0, len(ids)], ids).cast(ids_type), pa.array([x.astype("<i8" if wide else "<i4").tobytes()], pa.binary()), pa.array([wide])], names=["ids", "data", "wide"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            x = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)).astype(np.int64)
            at = 0
            while at < len(x):
                take = min(most - held, len(x) - at)
                ids.append(batch.column(0).slice(at, take))
                parts.append(x[at : at + take])
                held, at = held + take, at + take
                if held == most:
                    yield block(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield block(ids, parts)

    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType()), T.StructField("wide", T.BooleanType())])
    return saved(rows.filter(F.size("v") == dims).mapInArrow(tidy(pack), schema), "blocks"), dims


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and lattice values of each block."""
    for batch in batches:
        for ids, data, wide in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            yield ids.values, np.frombuffer(data.as_buffer(), "<i8" if wide.as_py() else "<i4").reshape(len(ids.values), dims)


def _sums(blocks: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over blocks of what `of` makes of each: sums of a task leave it as rows, which Spark adds up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, dims):
            now = of(x)
            total = now if total is None else total + now
        if total is not None:
            values = pa.array([str(int(t)) for t in total]) if exact else pa.array(np.asarray(total, float))
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), values], names=["slot", "value"])

    rows = blocks.mapInArrow(add, f"slot int, value {'string' if exact else 'double'}")
    found = rows.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)") if exact else F.col("value")).alias("value")).collect()
    found.sort(key=lambda r: r["slot"])
    return np.array([int(r["value"]) for r in found], object) if exact else np.array([r["value"] for r in found], float)


def _unit(r: np.ndarray, basis: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """r made orthogonal to the basis, twice, and its length."""
    for _ in range(2):
        for b in basis:
            r = r - (b @ r) * b
    return r, float(np.linalg.norm(r))


def bidiagonalised(product: Callable[[np.ndarray], np.ndarray], dims: int, leading: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, int]:
    """Singular values (falling) and right vectors (columns) of a matrix X, and the steps made.

    product(w) gives X'Xw followed by the squared length of Xw, each from one pass over the rows.
    """
    rng = np.random.default_rng(seed)
    right, left, back = [], [], []  # v of each step; w with u = Xw; X'u
    alphas, betas = [], []

    def fresh() -> tuple[np.ndarray | None, float]:
        """A vector of the row space that is orthogonal to `right`, or None if there is no more."""
        g, _ = _unit(rng.standard_normal(dims), right)
        r, length = _unit(product(g)[:dims], right)
        return (r / length if length > NOTHING * max([length, *(a * a for a in alphas)]) else None), 0.0

    v, beta = fresh()
    broken = False
    while v is not None:
        if right:
            betas.append(beta)
        right.append(v)
        w = v - beta * left[-1] if beta else v
        out = product(w)
        z, square = out[:dims], float(out[dims])
        for _ in range(2):
            for a, b in zip(left, back, strict=True):
                c = float(a @ z)
                w, z, square = w - c * a, z - c * b, square - c * c
        alpha = math.sqrt(max(square, 0.0))
        if alpha <= NOTHING * max([*alphas, beta, 0.0]):
            alphas.append(0.0)
            break
        alphas.append(alpha)
        basis = np.stack(right)
        left.append(basis.T @ (basis @ (w / alpha)))  # w lies in the span of `right`: what is outside is rounding
        back.append(z / alpha)
        if len(right) == dims:
            break
        r, beta = _unit(back[-1] - alpha * v, right)
        ends, values, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if beta <= NOTHING * values[0]:
            broken = True
            v, beta = fresh()
        elif not broken and len(alphas) >= leading and (beta * np.abs(ends[-1, :leading]) <= EPS * values[0]).all():
            break
        else:
            v = r / beta
    if not right:
        return np.zeros(0), np.zeros((dims, 0)), 0
    _, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    return values, np.stack(right, 1) @ turned.T, len(right)


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and leading component.

    deviation is null where it is beyond 64 bits.
    """
    blocks, dims = packed(vectors, key, vector)
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    facts = _sums(blocks, dims, lambda x: np.concatenate([x.sum(0, dtype=np.int64).astype(object), np.array([len(x)], object)]), exact=True)
    totals, n = facts[:dims], int(facts[dims])
    mean = np.array([int(s) / n for s in totals])

    def product(w: np.ndarray) -> np.ndarray:
        def both(x: np.ndarray) -> np.ndarray:
            rows = x - mean
            p = rows @ w
            return np.concatenate([p @ rows, [p @ p]])

        return _sums(blocks, dims, both)

    values, vectors_, _ = bidiagonalised(product, dims, min(components, dims))
    count = int((values[:components] > EPS * max(n, dims) * values[0]).sum()) if len(values) and values[0] > 0 else 0
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    basis = vectors_[:, :count]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(count)] < 0, -1.0, 1.0)
    scaled = basis / (values[:count] / math.sqrt(n))

    def moments(x: np.ndarray) -> np.ndarray:
        rows = x - mean
        white = rows @ scaled
        return np.concatenate([(white.T @ white).ravel(), white.sum(0), [(rows * rows).sum()]])

    found = _sums(blocks, dims, moments)
    shift = found[count * count : -1] / n
    error = float(np.abs(found[: count * count].reshape(count, count) / n - np.outer(shift, shift) - np.eye(count)).max())
    explained = values[:count] ** 2 / found[-1]

    def deviations(x: np.ndarray) -> pa.Array:
        bound = n * int(np.abs(x).max(initial=0)) + max(abs(int(s)) for s in totals)
        if dims * bound * bound < 2**63:
            d = n * x.astype(np.int64) - totals.astype(np.int64)
            return pa.array(np.einsum("rd,rd->r", d, d))
        d = n * x.astype(object) - totals
        return pa.array([s if s < 2**63 else None for s in (d * d).sum(1)], pa.int64())

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, dims):
            for a in range(0, len(x), 512):
                part = x[a : a + 512]
                m = len(part)
                each = pa.array(np.repeat(np.arange(m), count))
                tiled = lambda values, kind=None: pa.array(np.tile(values, m), kind)
                columns = [ids.slice(a, m).take(each), tiled(np.arange(1, count + 1), pa.int32()), tiled([n], pa.int64()).take(each), deviations(part).take(each), pa.array(((part - mean) @ scaled).ravel()), tiled(explained), pa.array(np.full(m * count, error))]
                yield pa.record_batch(columns, names=schema.names)

    return blocks.mapInArrow(tidy(rows_out), schema)
