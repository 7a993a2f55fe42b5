"""Moment tables: the only thing a model fit needs from the rows.

A frame of any length is reduced once to sums of cross products, in total or
per site, without being written.  They are about the column means, so large
offsets do not cancel.  Column 0 is the constant one; its products give counts and sums.

A few columns are one aggregate of Spark's own functions.  Of many columns
there are too many pairs for generated code; they are reduced batch by batch to
a state of count, means and scatter, and states are merged pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import combinations_with_replacement
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import sitepanel
from sitepanel.session import durable

# The merging helpers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sitepanel)

# More columns than this are reduced by batches.
AGGREGATED_COLUMNS = 8
# States of this many tasks meet in one.
MERGED_TASKS = 64

# Sites with fewer rows than this form one class per row count.  Larger sites
# are spread over the nodes of a Chebyshev rule on their octave of row counts.
EXACT_SIZES = 64
NODES = 24


def expand_terms(formula: Sequence[str]) -> list[str]:
    """``a*b`` to ``a``, ``b``, ``a:b``; main effects first, each term once."""
    main, products = [], []
    for part in formula:
        if "*" in part:
            factors = [f.strip() for f in part.split("*")]
            main += factors
            products.append(":".join(factors))
        elif ":" in part:
            products.append(part)
        else:
            main.append(part)
    return list(dict.fromkeys(main + products))


def factors(formula: Sequence[str]) -> list[str]:
    """The columns that the terms of a formula are made of."""
    return list(dict.fromkeys(name for term in expand_terms(formula) for name in term.split(":")))


def term_column(term: str) -> Column:
    """Value of a term: a column, or the product of the columns of an interaction."""
    value = None
    for name in term.split(":"):
        factor = F.col(f"`{name}`").cast("double")
        value = factor if value is None else value * factor
    return value


def model_frame(
    df: DataFrame,
    responses: Sequence[str],
    terms: Sequence[str],
    keep: Sequence[str] = (),
    na: str = "omit",
) -> DataFrame:
    """Complete cases of the model columns, with one column per term; not computed before it is read.

    ``na="fail"`` raises if a row had to be left out.
    """
    wanted = list(dict.fromkeys([*responses, *terms]))
    frame = df.select(*keep, *[term_column(t).alias(t) for t in wanted])
    if na == "fail":
        known = reduce(and_, [F.col(f"`{t}`").isNotNull() for t in wanted])
        every, whole = frame.agg(F.count(F.lit(1)), F.count(F.when(known, F.lit(1)))).first()
        if every != whole:
            raise ValueError("rows with missing model values")
    return frame.dropna(how="any", subset=[f"`{t}`" for t in wanted])


def _pair(i: int, j: int) -> str:
    return f"s_{min(i, j)}_{max(i, j)}"


def _pairs(size: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(size), 2))


def _one_pass(names: Sequence[str]) -> list[Column]:
    """Count, means and co-moments of all columns: their partial states merge without cancellation."""
    columns = [F.col(f"`{n}`") for n in names]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns, start=1)]
    spreads = [
        F.covar_pop(columns[i - 1], columns[j - 1]).alias(f"c_{i}_{j}") for i, j in _pairs(len(names) + 1) if i > 0
    ]
    return [F.count(F.lit(1)).alias("n"), *means, *spreads]


def _matrix(row, size: int, prefix: str = "s") -> np.ndarray:
    out = np.zeros((size, size))
    for i, j in _pairs(size):
        out[i, j] = out[j, i] = row[f"{prefix}_{i}_{j}"] or 0.0
    return out


@dataclass
class Moments:
    """Cross products of (1, names) about ``shift`` over all rows."""

    names: list[str]
    shift: dict[str, float]
    total: np.ndarray

    @property
    def n(self) -> float:
        return self.total[0, 0]


@dataclass
class Scatter:
    """Count, means and sums of products about the means of some rows."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Scatter:
        mean = rows.mean(axis=0)
        apart = rows - mean
        return Scatter(float(len(rows)), mean, apart.T @ apart)

    def merged(self, other: Scatter) -> Scatter:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Scatter(
            n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n)
        )


class ScatterTree:
    """States merged like binary digits, so that each meets one of about its own size."""

    def __init__(self):
        self.held: list[Scatter | None] = []

    def add(self, state: Scatter) -> None:
        for level, held in enumerate(self.held):
            if held is None:
                self.held[level] = state
                return
            state, self.held[level] = held.merged(state), None
        self.held.append(state)

    def whole(self) -> Scatter | None:
        return reduce(lambda a, b: a.merged(b), [s for s in self.held if s is not None]) if any(self.held) else None


_SCATTER = "part int, n double, mean binary, products binary"


def _scatter_rows(trees: dict[int, ScatterTree]) -> pa.RecordBatch:
    whole = [(part, tree.whole()) for part, tree in trees.items()]
    rows = [(part, s.n, s.mean.tobytes(), s.products.tobytes()) for part, s in whole if s is not None]
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = [pa.int32(), pa.float64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "n", "mean", "products"])


def _scatter_from(n: float, mean: bytes, products: bytes) -> Scatter:
    middle = np.frombuffer(mean)
    return Scatter(n, middle, np.frombuffer(products).reshape(len(middle), len(middle)))


def total_scatter(frame: DataFrame, names: Sequence[str]) -> Scatter:
    """State of all rows of the named columns, none of which is NULL."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ScatterTree()
        for batch in batches:
            if batch.num_rows:
                tree.add(Scatter.of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
        yield _scatter_rows({TaskContext.get().partitionId() // MERGED_TASKS: tree})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, ScatterTree] = {}
        for batch in batches:
            for row in batch.to_pylist():
                trees.setdefault(row["part"], ScatterTree()).add(_scatter_from(row["n"], row["mean"], row["products"]))
        yield _scatter_rows(trees)

    columns = frame.select(*[F.col(f"`{n}`").cast("double") for n in names])
    states = columns.mapInArrow(reduce_rows, _SCATTER).repartition("part").mapInArrow(merge, _SCATTER)
    tree = ScatterTree()
    for row in states.collect():  # one row for every MERGED_TASKS tasks
        tree.add(_scatter_from(row["n"], bytes(row["mean"]), bytes(row["products"])))
    size = len(columns.columns)
    return tree.whole() or Scatter(0.0, np.zeros(size), np.zeros((size, size)))


def total_moments(frame: DataFrame, names: Sequence[str]) -> Moments:
    """Moments about the column means, from one pass over the rows."""
    names = list(names)
    if len(names) > AGGREGATED_COLUMNS:
        state = total_scatter(frame, names)
        total = np.zeros((len(names) + 1,) * 2)
        total[0, 0] = state.n
        total[1:, 1:] = state.products
        return Moments(names, dict(zip(names, state.mean.tolist())), total)
    row = frame.agg(*_one_pass(names)).first()
    total = np.zeros((len(names) + 1,) * 2)
    total[0, 0] = row["n"]
    for i, j in _pairs(len(names) + 1):
        if i > 0:
            total[i, j] = total[j, i] = row["n"] * (row[f"c_{i}_{j}"] or 0.0)
    return Moments(names, {n: row[f"m{i}"] or 0.0 for i, n in enumerate(names, start=1)}, total)


@dataclass
class SizeClasses:
    """Site moments pooled by row count.

    ``sizes`` are row counts and ``weights`` numbers of sites; ``inner`` holds
    the pooled cross products of rows, ``outer`` the pooled outer products of
    site sums.  Every sum over sites of f(row count) times such a product, for
    the smooth f a random-intercept likelihood needs, equals the same sum over
    classes.
    """

    sizes: np.ndarray
    weights: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @property
    def total(self) -> np.ndarray:
        return self.inner.sum(axis=0)


@dataclass
class PooledMoments:
    """Size classes with the names and shifts of their columns: all a fit needs."""

    names: list[str]
    shift: dict[str, float]
    classes: SizeClasses

    def index(self, name: str) -> int:
        return self.names.index(name) + 1

    def derive(
        self, name: str, weights: np.ndarray, effect: np.ndarray, theta: float, shift: float
    ) -> PooledMoments:
        """Moments of a new row-level column, without reading the rows again.

        The column is ``shift`` + weights . z + k effect . s, with z the row's
        columns about their shifts (constant first), s the site's sums of z and
        k = theta / (1 + site rows * theta).  Its products are linear and
        quadratic forms of the pooled ones.
        """
        c = self.classes
        k = theta / (1.0 + c.sizes * theta)
        row_cross = c.inner @ weights + k[:, None] * (c.outer @ effect)
        row_square = (
            (c.inner @ weights) @ weights
            + 2 * k * ((c.outer @ effect) @ weights)
            + c.sizes * k**2 * ((c.outer @ effect) @ effect)
        )
        sums = weights[None, :] + (c.sizes * k)[:, None] * effect[None, :]
        site_cross = np.einsum("cab,cb->ca", c.outer, sums)
        site_square = np.einsum("ca,ca->c", site_cross, sums)
        return PooledMoments(
            [*self.names, name],
            {**self.shift, name: shift},
            SizeClasses(
                c.sizes, c.weights, _bordered(c.inner, row_cross, row_square),
                _bordered(c.outer, site_cross, site_square),
            ),
        )


def _bordered(block: np.ndarray, cross: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Append one row and column to each matrix of a stack."""
    m = block.shape[1]
    out = np.empty((block.shape[0], m + 1, m + 1))
    out[:, :m, :m] = block
    out[:, :m, m] = out[:, m, :m] = cross
    out[:, m, m] = corner
    return out


@dataclass
class SiteMoments:
    """One row of moments per site, with the names and shifts of the columns."""

    table: DataFrame
    site: str
    names: list[str]
    shift: dict[str, float]

    @property
    def size(self) -> int:
        return len(self.names) + 1

    def total_of(self, name: str) -> Column:
        """Site sum of a column about its shift."""
        return F.col(_pair(0, self.names.index(name) + 1))

    @property
    def rows(self) -> Column:
        return F.col(_pair(0, 0))

    @cached_property
    def pooled(self) -> PooledMoments:
        """Pool sites by row count: at most about a thousand rows however many sites there are.

        Up to EXACT_SIZES a class is a row count.  Above, each octave [a, 2a) of
        row counts has NODES interpolation nodes.  The likelihood's functions of
        the row count are analytic there with their only pole at or below zero,
        so interpolation is exact to rounding, and weights add up to one.
        """
        n = self.rows
        octave = F.floor(F.log2(n)).cast("int")
        low = F.pow(F.lit(2.0), octave)
        # position of the row count inside its octave, as an angle on [-1, 1]
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * n / low - 3.0)))
        node = F.explode(
            F.when(n < EXACT_SIZES, F.array(F.lit(-1))).otherwise(
                F.sequence(F.lit(0), F.lit(NODES - 1))
            )
        )
        spread = self.table.withColumns({"_octave": octave, "_angle": angle}).withColumn("_node", node)
        exact = F.col("_node") < 0
        node_angle = (F.col("_node") + 0.5) * math.pi / NODES
        cosines = F.aggregate(
            F.sequence(F.lit(1), F.lit(NODES - 1)),
            F.lit(0.0),
            lambda acc, k: acc + F.cos(k * node_angle) * F.cos(k * F.col("_angle")),
        )
        node_size = F.pow(F.lit(2.0), F.col("_octave")) * (1.5 + 0.5 * F.cos(node_angle))
        spread = spread.withColumns(
            {
                "_w": F.when(exact, F.lit(1.0)).otherwise((1.0 + 2.0 * cosines) / NODES),
                "_size": F.when(exact, n).otherwise(node_size),
                "_key": F.when(exact, n.cast("int")).otherwise(F.col("_octave")),
            }
        )
        pairs = _pairs(self.size)
        w = F.col("_w")
        rows = (
            spread.groupBy("_node", "_key")
            .agg(
                F.max("_size").alias("_size"),
                F.sum(w).alias("_sites"),
                *[F.sum(w * F.col(_pair(0, i)) * F.col(_pair(0, j))).alias(f"b_{i}_{j}") for i, j in pairs],
                *[F.sum(w * F.col(_pair(i, j))).alias(f"s_{i}_{j}") for i, j in pairs],
            )
            .collect()
        )
        classes = SizeClasses(
            sizes=np.array([r["_size"] for r in rows]),
            weights=np.array([r["_sites"] for r in rows]),
            inner=np.array([_matrix(r, self.size) for r in rows]),
            outer=np.array([_matrix(r, self.size, "b") for r in rows]),
        )
        return PooledMoments(self.names, self.shift, classes)


# Rows whose sites are told apart at once, and interpolation nodes of all classes.
ROWS_AT_ONCE = 1 << 17
_NODE_ANGLES = (np.arange(NODES) + 0.5) * math.pi / NODES


def size_class_weights(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The classes of sites with ``n`` rows: for each share the site's place, the key, the row count it stands for, the weight."""
    small = np.flatnonzero(n < EXACT_SIZES)
    large = np.flatnonzero(n >= EXACT_SIZES)
    octave = np.floor(np.log2(n[large]))
    angle = np.arccos(np.clip(2.0 * n[large] / 2.0**octave - 3.0, -1.0, 1.0))
    order = np.arange(1, NODES)
    waves = np.cos(angle[:, None] * order) @ np.cos(_NODE_ANGLES[:, None] * order).T
    # keys: the row count itself, or an octave's node, numbered from EXACT_SIZES on
    keys = EXACT_SIZES + octave[:, None] * NODES + np.arange(NODES)
    sizes = 2.0 ** octave[:, None] * (1.5 + 0.5 * np.cos(_NODE_ANGLES))
    places = np.concatenate([small, np.repeat(large, NODES)])
    weights = np.concatenate([np.ones(len(small)), ((1.0 + 2.0 * waves) / NODES).ravel()])
    return places, np.concatenate([n[small], keys.ravel()]).astype(np.int64), np.concatenate([n[small], sizes.ravel()]), weights


def _site_states(names: Sequence[str]):
    """A function of Arrow batches that gives each site's count, sums and products about the block's means."""
    p = len(names)
    upper = np.triu_indices(p)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def reduced() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            codes = block.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            if isinstance(codes, pa.ChunkedArray):
                codes = codes.combine_chunks()
            number = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            rows = np.column_stack([c.to_numpy() for c in block.columns[1:]])[order]
            middle = rows.mean(axis=0)
            rows -= middle
            n = np.diff(np.append(starts, len(rows))).astype(float)
            sums = np.add.reduceat(rows, starts, axis=0)
            products = np.concatenate([np.add.reduceat(rows[:, [i]] * rows[:, i:], starts, axis=0) for i in range(p)], axis=1)
            gap = sums / n[:, None]
            products -= (n[:, None] * gap[:, upper[0]]) * gap[:, upper[1]]
            values = np.concatenate([n[:, None], middle + gap, products], axis=1)
            # every kind of site came in as itself and leaves as itself
            sites = codes.dictionary.take(pa.array(number[order][starts]))
            return pa.RecordBatch.from_arrays([sites, _lists(values)], names=["site", "state"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                yield reduced()
                held, size = [], 0
        if held:
            yield reduced()

    return states


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class BatchedSiteMoments(SiteMoments):
    """Site moments of many columns: ``table`` holds the sums as columns and all products in one list, ``products``."""

    @cached_property
    def pooled(self) -> PooledMoments:
        p = len(self.names)
        m = p + 1
        upper = np.triu_indices(p)
        blocks = pa.list_(pa.float64())
        layout = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("size", pa.float64()), ("sums", blocks)])

        def added(held: dict, part: int) -> pa.RecordBatch:
            rows = [{"part": part, "key": k, "size": size, "sums": sums} for k, (size, sums) in held.items()]
            return pa.RecordBatch.from_pylist(rows, schema=layout)

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[float, np.ndarray]] = {}
            for batch in batches:
                sums = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:m]])
                inner = np.zeros((len(sums), m, m))
                inner[:, 0, :] = inner[:, :, 0] = sums
                cross = _matrix_of(batch.column(m), len(upper[0])) if batch.num_rows else np.zeros((0, len(upper[0])))
                inner[:, upper[0] + 1, upper[1] + 1] = inner[:, upper[1] + 1, upper[0] + 1] = cross
                places, keys, sizes, weights = size_class_weights(sums[:, 0])
                for key in np.unique(keys).tolist():
                    mine = keys == key
                    at, w = places[mine], weights[mine]
                    outer = np.einsum("t,ti,tj->ij", w, sums[at], sums[at])
                    value = np.concatenate([[w.sum()], np.einsum("t,tij->ij", w, inner[at]).ravel(), outer.ravel()])
                    before = held[key][1] if key in held else 0.0
                    held[key] = float(sizes[mine][0]), before + value
            yield added(held, TaskContext.get().partitionId() // MERGED_TASKS)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, dict] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    mine = held.setdefault(row["part"], {})
                    before = mine[row["key"]][1] if row["key"] in mine else 0.0
                    mine[row["key"]] = row["size"], before + np.array(row["sums"])
            for part, mine in held.items():
                yield added(mine, part)

        kind = "part int, key long, size double, sums array<double>"
        rows = self.table.select(*[F.col(_pair(0, i)) for i in range(m)], "products")
        whole: dict[int, tuple[float, np.ndarray]] = {}
        # at most a row per class for every MERGED_TASKS tasks
        for row in rows.mapInArrow(pool, kind).repartition("part").mapInArrow(merge, kind).collect():
            before = whole[row["key"]][1] if row["key"] in whole else 0.0
            whole[row["key"]] = row["size"], before + np.array(row["sums"])
        classes = [whole[k] for k in sorted(whole)]
        cells = m * m
        return PooledMoments(
            self.names, self.shift,
            SizeClasses(
                sizes=np.array([size for size, _ in classes]),
                weights=np.array([v[0] for _, v in classes]),
                inner=np.array([v[1 : 1 + cells].reshape(m, m) for _, v in classes]),
                outer=np.array([v[1 + cells :].reshape(m, m) for _, v in classes]),
            ),
        )


def _batched_site_moments(frame: DataFrame, site: str, names: list[str]) -> BatchedSiteMoments:
    """Site moments by batches: states of blocks of rows, brought to common means and added per site."""
    p = len(names)
    pairs = p * (p + 1) // 2
    upper = np.triu_indices(p)
    key = frame.select(F.col(f"`{site}`").alias("site")).schema["site"].dataType.simpleString()
    columns = frame.select(F.col(f"`{site}`").alias("site"), *[F.col(f"`{n}`").cast("double") for n in names])
    states = durable(columns.mapInArrow(_site_states(names), f"site {key}, state array<double>"))
    n = F.element_at("state", 1)
    means = [F.sum(n * F.element_at("state", i + 1)).alias(f"m{i}") for i in range(1, p + 1)]
    row = states.agg(F.sum(n).alias("n"), *means).first()
    shift = {name: (row[f"m{i}"] or 0.0) / (row["n"] or 1.0) for i, name in enumerate(names, start=1)}
    centre = np.array([shift[name] for name in names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the states of a site, which come one after the other."""
        last: tuple | None = None

        def table(sites: list, values: np.ndarray) -> pa.RecordBatch:
            sums = [pa.array(values[:, i]) for i in range(p + 1)]
            return pa.RecordBatch.from_arrays(
                [pa.array(sites, kind), *sums, _lists(values[:, p + 1 :])], names=["site", *[_pair(0, i) for i in range(p + 1)], "products"]
            )

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            sites, values = batch.column(0).to_pylist(), _matrix_of(batch.column(1), 1 + p + pairs).copy()
            gap = values[:, 1 : p + 1] - centre
            values[:, p + 1 :] += values[:, [0]] * gap[:, upper[0]] * gap[:, upper[1]]
            values[:, 1 : p + 1] = values[:, [0]] * gap
            if last is not None:
                sites, values = [last[0], *sites], np.vstack([last[1], values])
            starts = [0, *[i for i in range(1, len(sites)) if sites[i] != sites[i - 1]]]
            added = np.add.reduceat(values, starts, axis=0)
            if len(starts) > 1:
                yield table([sites[i] for i in starts[:-1]], added[:-1])
            last = sites[-1], added[-1]
        if last is not None:
            yield table([last[0]], last[1][None])

    made = ", ".join(f"{_pair(0, i)} double" for i in range(p + 1))
    added = states.repartition("site").sortWithinPartitions("site").mapInArrow(add, f"site {key}, {made}, products array<double>")
    return BatchedSiteMoments(durable(added.withColumnRenamed("site", site)), site, names, shift)


def site_moments(frame: DataFrame, site: str, names: Sequence[str]) -> SiteMoments:
    """Moments per site, materialised: fits, scores and chains all read this table.

    The rows are read once, for counts, means and co-moments, which combine
    inside the map tasks: a site that holds a large part of the rows costs one
    partial row per task.  The products about the means of all rows follow from
    those, site by site.
    """
    names = list(names)
    if len(names) > AGGREGATED_COLUMNS:
        return _batched_site_moments(frame, site, names)
    per_site = durable(frame.groupBy(site).agg(*_one_pass(names)))
    n = F.col("n").cast("double")
    weighted = [F.sum(n * F.col(f"m{i}")).alias(f"m{i}") for i in range(1, len(names) + 1)]
    row = per_site.agg(F.sum(n).alias("n"), *weighted).first()
    shift = {name: (row[f"m{i}"] or 0.0) / (row["n"] or 1.0) for i, name in enumerate(names, start=1)}
    gaps = [F.lit(1.0), *[F.col(f"m{i}") - F.lit(shift[name]) for i, name in enumerate(names, start=1)]]
    products = [
        (n * gaps[i] * gaps[j] + (n * F.col(f"c_{i}_{j}") if i > 0 else F.lit(0.0))).alias(_pair(i, j))
        for i, j in _pairs(len(names) + 1)
    ]
    return SiteMoments(per_site.select(site, *products), site, names, shift)
