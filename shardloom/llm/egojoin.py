"""Epsilon grid order join of embeddings: all links of at least a cosine, exactly.

Unit vectors link when their distance is at most eps = sqrt(2 - 2 cos). The vectors are turned onto
their principal axes and sorted by the cells of a grid of width eps on the leading ones, so that
neighbours in the sequence tend to be neighbours in space. The sequence is cut into blocks with
bounding boxes in all axes. Pairs of intervals of the sequence are joined recursively: an interval
pair whose boxes lie further apart than eps is skipped with all that it holds, others are halved
down to blocks, and within two blocks down to LEAF vectors, where a matrix product gives the cosines
in double precision. The recursion over blocks runs on the executors, STRIP blocks against the sequence in a task;
what every task knows of a block is its box in the BOX_AXES leading axes. A block holds at most BLOCK_BYTES,
so a task's memory doesn't grow with the table; up to FEW_BLOCKS blocks, blocks grow instead of the number of
copies that pairs of blocks need.

Equal vectors are one point with a weight, so copies cost nothing. A pair of blocks returns, for
each vector, the number of its links and the smallest id it is connected to there, never the links
themselves: what is written grows with vectors, not with links.

How much is skipped depends on the data: vectors that fill a sphere of many dimensions evenly have no
distant blocks, and then every pair of blocks is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import arrow_limits, components, need, shared_table

COSINE = 0.9
GRID_AXES = 4
#: Vectors of a block: at least BLOCK_ROWS, more if there would be over FEW_BLOCKS blocks, but never over BLOCK_BYTES as doubles.
BLOCK_ROWS, FEW_BLOCKS, BLOCK_BYTES = 4096, 32, 16 << 20
#: Blocks of a task of the recursion over blocks, and axes of their boxes (8 MB for a billion vectors of 64 dimensions).
STRIP, BOX_AXES = 64, 16
LEAF = 512
#: Of wider vectors only the leading axes are found, by TURNS steps of subspace iteration: all of them would take dim * dim sums.
TURN_DIMS, TURNS = 512, 5
ROW_BITS = 33


def usable(v: Column) -> Column:
    """True for a vector that has a direction: not null, all components there and finite, one of them not 0."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) if isinstance(column, pa.Array) else np.stack(column.to_numpy()).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(points: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors as columns, largest variance first; from sums over all of them."""
    if dim > TURN_DIMS:
        return _leading(points, dim, min(dim, max(GRID_AXES, BOX_AXES)))
    at = np.triu_indices(dim + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = _unit(b.column(0), dim)
            x = np.column_stack([np.ones(len(x)), x])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0]), dtype=np.int32)), pa.array(total[at])], names=["k", "v"])

    rows = points.select("vec").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    if not len(rows):
        return np.eye(dim)
    m = np.zeros((dim + 1, dim + 1))
    m[at[0][rows["k"]], at[1][rows["k"]]] = rows["v"]
    m = m + np.triu(m, 1).T
    mean = m[0, 1:] / m[0, 0]
    return np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1]


def _leading(points: DataFrame, dim: int, axes: int) -> np.ndarray:
    """About the leading principal axes, orthonormal columns: a fixed start is multiplied by the covariance and made orthonormal again, a pass over the vectors each time."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, axes)))[0]
    for _ in range(TURNS):

        def product(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dim + 1, axes + 1))
            for b in batches:
                x = np.column_stack([np.ones(b.num_rows), _unit(b.column(0), dim)])
                total += x.T @ np.column_stack([np.ones(len(x)), x[:, 1:] @ q])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["k", "v"])

        rows = points.select("vec").mapInArrow(product, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        if not len(rows):
            return q
        m = np.zeros((dim + 1) * (axes + 1))
        m[rows["k"]] = rows["v"]
        m = m.reshape(dim + 1, axes + 1) / rows["v"][rows["k"] == 0].iloc[0]
        q = np.linalg.qr(m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:]))[0]
    return q


def _boxes(y: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(y), step)
    return np.minimum.reduceat(y, at), np.maximum.reduceat(y, at)


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """The least distance of points in two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(np.sqrt((gap * gap).sum()))


def interval_pairs(lo: np.ndarray, hi: np.ndarray, eps: float, lo_b: np.ndarray | None = None, hi_b: np.ndarray | None = None, strip: tuple[int, int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of boxes that can hold points within eps, by recursion over intervals of both sequences.

    Without lo_b, the sequence is joined with itself and i <= j; with strip, only those of i from strip[0] to below strip[1].
    """
    own = lo_b is None
    lo_b, hi_b = (lo, hi) if own else (lo_b, hi_b)
    if not len(lo) or not len(lo_b):
        return
    eps = eps * (1 + 1e-9) + 1e-12  # what rounding may add
    stack = [(*(strip or (0, len(lo))), 0, len(lo_b))]
    while stack:
        a, b, c, d = stack.pop()
        if own and a >= d:
            continue  # below the diagonal
        if apart(lo[a:b].min(0), hi[a:b].max(0), lo_b[c:d].min(0), hi_b[c:d].max(0)) > eps:
            continue
        if b - a == 1 and d - c == 1:
            if not own or a <= c:
                yield a, c
        elif b - a >= d - c:
            mid = (a + b) // 2
            stack += [(a, mid, c, d), (mid, b, c, d)]
        else:
            mid = (c + d) // 2
            stack += [(a, b, c, mid), (a, b, mid, d)]


def block_links(x: np.ndarray, z: np.ndarray | None, y: np.ndarray, yz: np.ndarray | None, eps: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all links of two blocks of unit vectors (i < j within one block, if z is None). y, yz: the turned vectors."""
    own = z is None
    other, turned = (x, y) if own else (z, yz)
    left, right = [], []
    for p, q in interval_pairs(*_boxes(y, LEAF), eps, *(() if own else _boxes(turned, LEAF))):
        i, j = np.nonzero(x[p * LEAF : (p + 1) * LEAF] @ other[q * LEAF : (q + 1) * LEAF].T >= cosine)
        i, j = i + p * LEAF, j + q * LEAF
        keep = i < j if own else slice(None)
        left.append(i[keep])
        right.append(j[keep])
    none = np.empty(0, int)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def least_labels(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each place is connected to by links (i, j)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return label
        label = new


def _join(points: DataFrame, dim: int, cosine: float) -> DataFrame:
    """id, n (weight of the vectors linked), least (smallest id it is connected to) of points (id, weight, vec); several rows for an id."""
    spark = points.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    turn = spark.sparkContext.broadcast(_axes(points, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _unit(b.column(2), dim) @ turn.value[:, :GRID_AXES]
            cells = np.floor(y / eps).astype(np.int32) if eps else np.zeros((len(y), GRID_AXES), np.int32)
            cells = np.pad(cells, ((0, 0), (0, max(0, GRID_AXES - cells.shape[1]))))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cells[:, k]) for k in range(GRID_AXES)), pa.array(y[:, 0])], names=["id", "weight", "vec", *(f"c{k}" for k in range(GRID_AXES)), "y0"])

    cells = ", ".join(f"c{k} int" for k in range(GRID_AXES))
    placed = points.select("id", "weight", "vec").mapInArrow(place, f"id long, weight long, vec array<double>, {cells}, y0 double")
    order = [*(f"c{k}" for k in range(GRID_AXES)), "y0", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "weight", "vec", F.monotonically_increasing_id().alias("rid"))
    ranged = shared_table(ranged, "ordered")
    # the place in the whole sequence: places within a partition, and how many rows the partitions before hold (a row for each)
    runs = ranged.groupBy(F.shiftright("rid", ROW_BITS).alias("pid")).agg(F.count("*").alias("n"))
    runs = runs.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = ranged.withColumn("pid", F.shiftright("rid", ROW_BITS)).join(runs, "pid")
    rows = rows.withColumn("place", F.col("before") + F.col("rid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    most = max(LEAF, BLOCK_BYTES // (8 * dim))
    size = F.least(F.lit(most), F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("total") / FEW_BLOCKS)))
    rows = shared_table(rows.select("id", "weight", "vec", "place", F.floor(F.col("place") / size).cast("int").alias("block")), "blocks")

    axes = min(dim, BOX_AXES)

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo: dict[int, np.ndarray] = {}
        hi: dict[int, np.ndarray] = {}
        for b in batches:
            y, block = _unit(b.column(0), dim) @ turn.value[:, :axes], b.column(1).to_numpy()
            for k in np.unique(block):
                own = y[block == k]
                lo[k] = np.minimum(lo.get(k, np.inf), own.min(0))
                hi[k] = np.maximum(hi.get(k, -np.inf), own.max(0))
        for k in lo:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(axes, k, np.int32)), pa.array(np.arange(axes, dtype=np.int32)), pa.array(lo[k]), pa.array(hi[k])], names=["block", "k", "lo", "hi"])

    boxes = rows.select("vec", "block").mapInArrow(box, "block int, k int, lo double, hi double").groupBy("block", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
    blocks = int(boxes["block"].max()) + 1 if len(boxes) else 0
    lo, hi = np.full((blocks, axes), np.inf), np.full((blocks, axes), -np.inf)
    lo[boxes["block"], boxes["k"]], hi[boxes["block"], boxes["k"]] = boxes["lo"], boxes["hi"]
    sent = spark.sparkContext.broadcast((lo, hi))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                found = interval_pairs(*sent.value, eps, strip=(first * STRIP, min(blocks, (first + 1) * STRIP)))
                while part := list(islice(found, 100_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*part, strict=True)], names=["i", "j"])

    strips = -(-blocks // STRIP)
    pairs = spark.range(0, strips, 1, max(1, strips)).mapInArrow(near, "i int, j int")
    # a row for each block and pair of blocks that it is in
    side = lambda c, n: F.struct(F.col(c).alias("block"), F.lit(n).alias("side"))
    told = pairs.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(side("i", 0))).otherwise(F.array(side("i", 0), side("j", 1)))).alias("e")).select("i", "j", "e.*")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "place"], ignore_index=True)
        x, ids, weight = _unit(pdf["vec"], dim), pdf["id"].to_numpy(), pdf["weight"].to_numpy()
        y = x @ turn.value
        n = int((pdf["side"] == 0).sum())
        if n == len(pdf):
            i, j = block_links(x, None, y, None, eps, cosine)
        else:
            i, j = block_links(x[:n], x[n:], y[:n], y[n:], eps, cosine)
            j = j + n
        if not len(i):
            return pd.DataFrame({"id": ids[:0], "n": weight[:0], "least": ids[:0]})
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        least = least_labels(ids, i, j)
        hit = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[hit], "n": np.rint(links[hit]).astype(np.int64), "least": least[hit]})

    return rows.join(told, "block").groupBy("i", "j").applyInPandas(link, "id long, n long, least long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links long, component_id long, kept boolean of each row.

    Vectors that are null, of zero length, zero, or hold null or non-finite components link with
    nothing, as do rows without id; vectors of different length aren't compared. Equal vectors link
    with each other; rows that repeat an id count as so many vectors. Other columns are left out; an
    empty table gives an empty result.
    """
    need(vectors, vec_id, embedding)
    arrow_limits(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    good = rows.where(usable(F.col("vec")) & F.col("id").isNotNull())
    points = shared_table(good.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "points")
    dims = [r[0] for r in points.select(F.size("vec")).distinct().collect()]
    found = [_join(points.where(F.size("vec") == d), d, cosine) for d in sorted(dims)]
    links = vectors.sparkSession.createDataFrame([], "id long, n long, least long") if not found else found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    links = shared_table(links, "links")
    label = components(links.select(F.col("id").alias("a"), F.col("least").alias("b")))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    told = points.join(counts, "id", "left").join(label, "id", "left").select("vec", F.col("id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    lone = rows.where(~(usable(F.col("vec")) & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.join(told, "vec").select("id", "n_links", "component_id").unionAll(lone)
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
