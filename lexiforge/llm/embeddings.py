"""Near-duplicate embeddings by randomised-rotation binary codes (RaBitQ).

Equal vectors of a label form a class. A label of at most EXACT classes is one cell around the origin. In a larger
one, a class's unit vector is given to its nearest cell (centroids fitted on a bounded sample; their number follows
the table's), and visits those whose border with its own is within half the
length of the longest link's chord: of two linked vectors, one visits the other's cell. In a cell, a vector is the centroid plus a residual; the rotated residual's signs are its code, and the code's inner
product with the residual is stored as the correction factor. From the codes every pair gets a bound that its
cosine cannot exceed, and only pairs whose bound reaches the threshold are computed anew, in double precision; so
no link is lost. A cell too large for a task is cut into parts, each pair of which is a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_shuffles, materialize, release, small_batches

#: Classes of a label that aren't dealt to cells: so few that to code all is less work than to visit cells.
EXACT = 200_000
#: Vectors that centroids are fitted on, wanted in a cell, most cells, and most of a cell in a task.
SAMPLE, PER_CELL, CELLS, PART = 20_000, 1_000, 2_048, 6_000


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def unit_vectors(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, all of a length, scaled to length 1 in double precision."""
    flat = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Binary codes of unit vectors around a centroid."""

    def __init__(self, x: np.ndarray, centroid: np.ndarray, turn: np.ndarray):
        r = (x - centroid) @ turn
        self.norm = np.linalg.norm(r, axis=1)
        unit = np.divide(r, self.norm[:, None], out=np.zeros_like(r), where=self.norm[:, None] > 1e-12)
        self.bits = np.packbits(unit > 0, axis=1)
        self.dim = x.shape[1]
        self.factor = np.abs(unit).sum(1) / np.sqrt(self.dim)  # <code, residual>
        self.at_centroid = x @ centroid
        self.square = float(centroid @ centroid)

    def signs(self, i: int, j: int) -> np.ndarray:
        return (np.unpackbits(self.bits[i:j], axis=1, count=self.dim).astype(np.float32) * 2 - 1) / np.sqrt(self.dim)

    def upper(self, i: int, j: int, other: Codes, query: np.ndarray, sigmas: float | None = None) -> np.ndarray:
        """Upper bounds of the cosines of items i:j with the rotated unit residuals query of other: certain ones, or
        with sigmas those of an unbiased estimate so many deviations up."""
        f = np.maximum(self.factor[i:j], 1e-6)[:, None]
        along = self.signs(i, j) @ query.T
        if sigmas is None:
            # a residual is f code + sqrt(1 - f^2) of something orthogonal to the code
            most = f * along + np.sqrt(np.maximum(1 - f * f, 0)) * np.sqrt(np.maximum(1 - along * along, 0) + 1e-6)
        else:
            most = along / f + sigmas * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(1, self.dim - 1))
        # <x, y> = <x, c> + <y, c> - <c, c> + |x - c| |y - c| <residuals>
        scale = self.norm[i:j][:, None] * other.norm[None, :]
        return self.at_centroid[i:j][:, None] + other.at_centroid[None, :] - self.square + scale * np.minimum(1.0, most)

    def may(self, i: int, j: int, other: Codes, query: np.ndarray, least: float) -> np.ndarray:
        """Whether the certain bounds of upper reach least, or a little less. Around the origin that is one look at
        each product: the bound f a + sqrt(1 - f^2) sqrt(1 - a^2) is cos(arccos a - arccos f), so it reaches least
        for no a under cos(arccos f + arccos least)."""
        if self.square or (self.norm[i:j] < 1e-12).any():
            return self.upper(i, j, other, query) >= least - 1e-5
        lowest = np.cos(np.minimum(np.arccos(np.minimum(self.factor[i:j], 1.0)) + np.arccos(np.clip(least, -1, 1)), np.pi))
        return self.signs(i, j) @ query.T >= (lowest - 1e-5).astype(np.float32)[:, None]


def _cells(shared, least: float):
    """Each vector's home and the cells it visits.

    For x, y with homes a, b: x (a - b) and y (b - a) are not negative and their sum (x - y) (a - b) is at most
    |x - y| |a - b|, so the smaller is at most half that, |x - y| being at most sqrt(2 - 2 least) in a link."""

    def run(batches):
        c = shared.value
        square = (c * c).sum(1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 0)) * np.sqrt(max(0.0, 2 - 2 * least)) / 2 + 1e-6
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_vectors(b.column(b.schema.get_field_index("v")))
            rows: list[np.ndarray] = []
            homes = np.zeros(len(x), np.int32)
            for a in range(0, len(x), 1000):
                near = x[a : a + 1000] @ c.T
                homes[a : a + 1000] = near.argmax(1)
                rows += [np.flatnonzero(r.max() - r <= apart[h]).astype(np.int32) for r, h in zip(near, homes[a : a + 1000], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in ("cls", "label", "copies", "v")), pa.array(homes), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], ["cls", "label", "copies", "v", "home", "visits"])

    return run


def _match(shared, least: float):
    def run(tbl: pa.Table) -> pa.Table:
        col = lambda n: tbl.column(n).to_numpy()
        cell, x_part = int(col("cell")[0]), int(col("x")[0])
        cls, copies, home, part = col("cls"), col("copies"), col("home"), col("part")
        v, visits = unit_vectors(tbl.column("v")), tbl.column("visits").to_pylist()
        order = np.lexsort((cls, part, home != cell))  # those at home first
        cls, copies, home, part, v = cls[order], copies[order], home[order], part[order], v[order]
        visits = [frozenset(visits[i]) for i in order]
        n_home = int((home == cell).sum())
        centroid, turn = np.zeros(v.shape[1]) if cell < 0 else shared.value[cell], rotation(v.shape[1])
        codes = Codes(v, centroid, turn)
        residual = ((v - centroid) @ turn).astype(np.float32)
        residual /= np.maximum(codes.norm, 1e-12)[:, None].astype(np.float32)
        links, comp = np.zeros(len(cls), np.int64), np.arange(len(cls))
        edges = []
        whole = int(col("y")[0]) == x_part
        # where all are at home the smaller part comes first and meets the other alone
        split = int((part == part[0]).sum()) if cell < 0 and not whole else 0
        n_home = split or n_home
        for a in range(0, n_home, 512):
            b = min(n_home, a + 512)
            for q in range(split or a, len(cls), 2048):
                r = min(len(cls), q + 2048)
                other = Codes.__new__(Codes)
                other.norm, other.at_centroid = codes.norm[q:r], codes.at_centroid[q:r]
                may = codes.may(a, b, other, residual[q:r], least)
                if q < b:
                    may &= np.arange(a, b)[:, None] < np.arange(q, r)[None, :]
                if not whole and not split:
                    may &= part[a:b, None] != part[None, q:r]
                i, j = np.divmod(np.flatnonzero(may), r - q)
                i, j = i + a, j + q
                for s in range(0, len(i), 200_000):
                    ii, jj = i[s : s + 200_000], j[s : s + 200_000]
                    ok = np.einsum("ij,ij->i", v[ii], v[jj]) >= least
                    ii, jj = ii[ok], jj[ok]
                    # a pair of two homes that meets in both is counted in the smaller cell
                    away = np.flatnonzero(home[jj] != cell)
                    if len(away):
                        twice = np.array([home[jj[k]] < cell and int(home[jj[k]]) in visits[ii[k]] for k in away], bool)
                        keep = np.ones(len(ii), bool)
                        keep[away[twice]] = False
                        ii, jj = ii[keep], jj[keep]
                    np.add.at(links, ii, copies[jj])
                    np.add.at(links, jj, copies[ii])
                    # a forest of the links is enough for the components
                    new = comp[ii] != comp[jj]
                    for p, w in zip(ii[new], jj[new], strict=True):
                        if comp[p] != comp[w]:
                            edges.append((cls[p], cls[w]))
                            comp[comp == comp[w]] = comp[p]
        hit = np.flatnonzero(links)
        return pa.table({"a": pa.array([*cls[hit], *(e[0] for e in edges)], pa.int64()), "b": pa.array([*[None] * len(hit), *(e[1] for e in edges)], pa.int64()), "n": pa.array([*links[hit].tolist(), *[None] * len(edges)], pa.int64())})

    return run


def embedding_components(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, per_cell: int = PER_CELL, part: int = PART, exact: int = EXACT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Only rows of an equal label and length of vector are compared. A row whose label is null, or whose vector is
    null, zero or has a null or non-finite component, links with nothing; so does one without vec_id, whose
    component_id is null and which isn't kept. Of rows that share a vec_id and vector each is linked with the
    others."""
    spark = rows.sparkSession
    small_batches(spark, 5000)
    # vectors stay as they were given, since unit vectors in double precision take twice the space of floats
    kind = rows.select(vector).schema[0].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("u"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.array_max(F.transform("v", F.abs))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & (most > 0), F.lit(False))
    unit = rows.withColumn("good", good).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(7), "v"))
    unit = unit.withColumn("label", F.when(F.col("good"), F.concat_ws(":", F.size("v"), "label")))
    whole = materialize(unit.select("vec_id", "good", "label", "k1", "k2", F.when(F.col("good"), F.col("u")).alias("u")))
    classes = materialize(whole.where("good").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.first("u").alias("v")))
    unit = materialize(whole.drop("u"))
    release(whole)
    free_shuffles(spark)
    good, n_classes = unit.where("good"), classes.count()
    big = materialize(classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).where(F.col("n") > exact))
    sizes = {r.d: r.n for r in big.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    found, tasks = None, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # one index a length of vectors, and one cell for each other label; big has fewer than rows / exact rows
    alone = classes.join(F.broadcast(big.select("label")), "label", "left_anti")
    for dim, n in [(0, 0), *sizes.items()]:
        if dim:
            some = classes.join(F.broadcast(big.where(F.col("d") == dim).select("label")), "label", "left_semi")
            sample = unit_vectors(pa.array([r.v for r in some.orderBy(F.xxhash64("k1")).limit(SAMPLE).select("v").collect()], pa.list_(pa.float64())))
            shared = spark.sparkContext.broadcast(fit_centroids(sample, min(CELLS, max(1, n // per_cell), max(1, len(sample) // 8))))
            dealt = materialize(some.mapInArrow(_cells(shared, least), f"cls long, label string, copies long, v array<{kind}>, home int, visits array<int>"))
        else:
            shared = spark.sparkContext.broadcast(np.zeros((0, 0)))
            dealt = alone.select("cls", "label", "copies", "v", F.lit(-1).alias("home"), F.array(F.lit(-1)).alias("visits"))
        there = dealt.select("cls", "label", "copies", "v", "home", "visits", F.explode("visits").alias("cell"))
        size = materialize(there.groupBy("label", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int")))
        sent = size.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
        # fewer than a part's share of the rows, so they are sent to where the vectors are
        there = there.join(F.broadcast(size.where("parts > 1").select("label", "cell", "parts")), ["label", "cell"], "left").fillna(1, ["parts"])
        there = there.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        there = there.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
        # vectors go to many tasks; in rounds, of which each sends about as many as there are, so that disk is bounded
        rounds = max(1, -(-sent // max(1, n_classes)))
        for r in range(rounds):
            turn = there if rounds == 1 else there.where(F.pmod(F.xxhash64("label", "cell", "x", "y"), F.lit(rounds)) == r)
            # little data and much work: adaptive execution would put many pairs of parts into one task
            turn = turn.repartition(tasks, "label", "cell", "x", "y")
            pairs = materialize(turn.groupBy("label", "cell", "x", "y").applyInArrow(_match(shared, least), "a long, b long, n long"))
            free_shuffles(spark)
            found = pairs if found is None else found.unionByName(pairs)
        if dim:
            release(dealt)
    links = found.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = materialize(connected_components(found.where("b is not null")))
    about = classes.join(links, "cls", "left").join(roots, F.col("cls") == F.col("id"), "left").select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = good.join(about, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = unit.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embed_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label at cosine 0.93; what links with nothing: see embedding_components.
    Repeated rows each have their row; other columns don't matter."""
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
