"""Near-duplicate vectors by PCA-ordered tiled comparison."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twoclock.session import kept

from .common import components

_SLACK = 1e-5  # of bounds in single precision; links are decided in double


def _second_moments(batches):
    """Sums over one partition of products of the coordinates of unit vectors."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            x /= np.linalg.norm(x, axis=1)[:, None]
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        d = len(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d * d), pa.int64()), pa.array(total.ravel())], ["cell", "s"])


def _matrix(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_axes(vectors, dim):
    """A basis of all `dim` axes, by falling variance, of the unit vectors in a frame of
    one array column: the moments are summed over every row, dim * dim numbers come to
    the driver."""
    rows = (vectors.mapInArrow(_second_moments, "cell long, s double")
            .groupBy("cell").agg(F.sum("s").alias("s")).collect())
    moments = np.zeros(dim * dim)
    for r in rows:
        moments[r["cell"]] = r["s"]
    values, axes = np.linalg.eigh(moments.reshape(dim, dim))
    return axes[:, np.argsort(values)[::-1]]


class Comparer:
    """Finds the pairs of two sets of vectors with cosine of `least` or more.

    Coordinates along the principal axes are taken in steps, leading ones first. What the
    remaining ones can still add is at most the product of the suffix norms (Cauchy and
    Schwarz), so a pair stops once the dot product so far plus that bound is below
    `least`. Norms ride as one more coordinate, which makes the bound of a whole tile a
    single matrix product.
    """

    def __init__(self, axes, least, tile=1024):
        self.axes, self.least, self.tile = axes, least, tile
        dim = axes.shape[0]
        self.steps = sorted({max(1, dim * k // 4) for k in (1, 2, 3)} | {dim})

    def prepared(self, x):
        norms = np.linalg.norm(x, axis=1)
        r = (x / norms[:, None]) @ self.axes
        left = np.sqrt(np.maximum(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], 0))
        left = np.column_stack([left, np.zeros(len(x))])
        lead = self.steps[0]
        bound = np.column_stack([r[:, :lead], left[:, lead]]).astype(np.float32)
        return x, norms, r, left, bound

    def pairs(self, a, b, same):
        """Yields (rows of a, rows of b) tile by tile; with `same`, each pair once."""
        for i in range(0, len(a[0]), self.tile):
            for j in range(i if same else 0, len(b[0]), self.tile):
                near = a[4][i:i + self.tile] @ b[4][j:j + self.tile].T >= self.least - _SLACK
                if same and i == j:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                p, q = np.nonzero(near)
                for lo in range(0, len(p), 100_000):
                    u, v = self._settled(a, b, p[lo:lo + 100_000] + i, q[lo:lo + 100_000] + j)
                    if len(u):
                        yield u, v

    def _settled(self, a, b, u, v):
        done, sums = 0, np.zeros(len(u))
        for step in self.steps[:-1]:
            sums += np.einsum("ij,ij->i", a[2][u, done:step], b[2][v, done:step])
            stay = sums + a[3][u, step] * b[3][v, step] >= self.least - _SLACK
            u, v, sums, done = u[stay], v[stay], sums[stay], step
        cosine = np.einsum("ij,ij->i", a[0][u], b[0][v]) / (a[1][u] * b[1][v])
        stay = cosine >= self.least
        return u[stay], v[stay]


def _joined(parent, u, v):
    """Joins nodes u and v in a forest in which every node points to its root."""
    while True:
        p, q = parent[u], parent[v]
        apart = p != q
        if not apart.any():
            return parent
        u, v, p, q = u[apart], v[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def _compared(axes, least):
    def run(table):
        comparer = Comparer(axes, least)
        side = table.column("side").to_numpy()
        order = np.concatenate([np.flatnonzero(side == 0), np.flatnonzero(side == 1)])
        n = int((side == 0).sum())
        table = table.take(pa.array(order))
        ids, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        x = _matrix(table.column("vector"))
        a = comparer.prepared(x[:n])
        same = n == len(x)
        b = a if same else comparer.prepared(x[n:])
        shift = 0 if same else n
        links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
        for u, v in comparer.pairs(a, b, same):
            v = v + shift
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            parent = _joined(parent, u, v)
        held = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[held], pa.int64()),
                         "links": pa.array(links[held], pa.int64()),
                         "root": pa.array(ids[parent[held]], pa.int64())})
    return run


def _partners(bounds, reach):
    """For tiles in order of their leading coordinate, [(lowest, highest)] of it: the
    first and the last tile that can hold a vector within `reach`."""
    low, high = (np.array(b) for b in zip(*bounds, strict=True))
    first = np.searchsorted(np.maximum.accumulate(high), low - reach)
    last = np.searchsorted(low, high + reach, side="right") - 1
    return [(int(f), int(t)) for f, t in zip(first, last, strict=True)]


def _links_of(vectors, dim, least, group):
    """(node, links, root) of distinct vectors (node, copies, vector) of one length."""
    axes = principal_axes(vectors.select("vector"), dim)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    weights = F.array(*[F.lit(float(w)) for w in axes[:, 0]])
    lead = F.aggregate(F.zip_with("vector", weights, lambda v, w: v * w),
                       F.lit(0.0), lambda s, v: s + v) / norm
    # Tiles are runs of at most `group` vectors in the order of the leading coordinate:
    # parts come from a range partitioning, tiles from positions within parts.
    ranged = kept(vectors.withColumn("lead", lead).repartitionByRange("lead", "node")
                  .withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in
             ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [0] * (max(sizes, default=0) + 1), 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    base = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("part") + 1)
    at = F.row_number().over(W.partitionBy("part").orderBy("lead", "node")) - 1 + base
    tiled = kept(ranged.withColumn("tile", F.floor(at / group).cast("int")).drop("part"))
    bounds = [(r["lo"], r["hi"]) for r in tiled.groupBy("tile").agg(
        F.min("lead").alias("lo"), F.max("lead").alias("hi")).orderBy("tile").collect()]
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + _SLACK
    spans = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t"))
                      for f, t in _partners(bounds, reach)])
    span = F.element_at(spans, F.col("tile") + 1)
    dealt = tiled.withColumn("other", F.explode(F.sequence(span["f"], span["t"])))
    dealt = dealt.select(
        F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
        F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"),
        "node", "copies", "vector")
    return dealt.groupBy("a", "b").applyInArrow(
        _compared(axes, least), "node long, links long, root long")


def near_duplicates(vectors, vec_id="vec_id", vector="embedding", least=0.95, group=4096):
    """(vec_id, n_links, component_id, kept) for each row of `vectors`.

    Vectors link if their cosine, in double precision, is `least` (above 0) or more;
    n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable, and a row is kept if that is its own. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, nor do vectors of different
    lengths, and rows without a vec_id, which are kept with no component. Rows that share
    a vec_id are one node, and each counts as a link. An empty table gives an empty result.

    Equal vectors meet in one grouping and are compared once, with their number. Distinct
    ones are cut into tiles of `group` along the first principal axis; two tiles are
    compared, each pair by one task, unless they are further apart on it than two linked
    unit vectors can be. A task returns a count and one spanning edge per linked vector,
    never pairs. The comparison is exact, and in the worst case quadratic in the number
    of distinct vectors.
    """
    row = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                         F.col(vector).cast("array<double>").alias("vector"))
    fit = (F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
           & F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v)
                                 & (F.abs(v) < float("inf"))), F.lit(False))
           & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False)))
    # Squares of very large or small numbers leave the range of doubles; a power of two
    # brings a whole vector back and changes no digit of its cosines.
    most = F.array_max(F.transform("vector", F.abs))
    scale = F.when(most > 1e150, 2.0 ** -600).when(most < 1e-150, 2.0 ** 600)
    usable = row.where(fit).withColumn("scale", scale).withColumn("vector", F.when(
        F.col("scale").isNull(), F.col("vector")).otherwise(
            F.transform("vector", lambda v: v * F.col("scale")))).drop("scale")
    nodes = kept(usable.groupBy("vector").agg(F.min("vec_id").alias("node"),
                                              F.count(F.lit(1)).alias("copies"))
                 .withColumn("dim", F.size("vector")))
    found = None
    for r in nodes.select("dim").distinct().orderBy("dim").collect():
        part = _links_of(nodes.where(F.col("dim") == r["dim"]).drop("dim"), r["dim"],
                         least, group)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = nodes.sparkSession.createDataFrame([], "node long, links long, root long")
    found = kept(found)
    reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.select("vector", "node", "copies").join(links, "node", "left")
             .join(reach, "node", "left")
             .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
                     .alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    linked = usable.join(known, "vector").select("vec_id", "n_links", "component_id")
    rest = row.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                  F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
