"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Unit vectors u, v with cosine c or more are no farther apart than e = sqrt(2 - 2c). If u's cell has centroid p and v's
q, then v lies within e of the plane halfway between p and q: v.q - v.p <= e * |q - p|. A vector that visits, besides
its own cell, every cell p within that border meets all its neighbours, whatever the centroids are. In many dimensions
these borders rule out next to nothing, so work would grow with the square of the rows. By default borders are drawn
closer, where a neighbour at the threshold in a random direction still stays inside with `spread` standard deviations;
a pair is found if either of the two visits the other's cell. The number of cells follows the rows, so a cell's size
and the work for a vector stay about the same. Every pair that is found is compared in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.graph import components
from glyphmill.llm.scratch import cut, drop

COSINE = 0.95
#: Standard deviations of a random neighbour's way that borders leave room for; None: the exact borders.
SPREAD = 2.5
#: Vectors of a cell on average. Tables of fewer rows are one cell and compared whole.
CELL = 1024
#: Bytes of all centroids of a length at most, a bound for what is broadcast: beyond, cells grow and are compared in more blocks.
CENTROID_BYTES = 64 << 20
#: Cells from which on vectors find theirs through coarse cells.
COARSE = 1024
#: Vectors that centroids are fitted on: so many at least, so many for each cell, and bytes of them at most.
SAMPLE, SAMPLE_EACH, SAMPLE_BYTES = 20_000, 16, 128 << 20
#: Vectors of a cell compared in one block: those that are at home in it with those that visit it, in tiles of so many rows.
ROWS, COLS, TILE = 4096, 8192, 512


def unit_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    n = len(vectors)
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    inner = vectors.flatten()
    flat = inner.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ok = (lengths == dim) & (dim > 0)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    out = np.zeros((n, max(dim, 1)))
    if ok.any():
        rows = np.array(flat[(starts[ok][:, None] + np.arange(dim)).ravel()]).reshape(-1, dim)
        most = np.abs(rows).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        scaled = rows[good] / most[good][:, None]  # no overflow
        scaled /= np.linalg.norm(scaled, axis=1)[:, None]
        at = np.flatnonzero(ok)
        ok[at[~good]] = False
        out[at[good]] = scaled
    return out, ok


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k unit centroids of the unit rows x; fewer if x has fewer rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        lost = norm < 1e-12
        if lost.any():
            sums[lost] = x[rng.choice(len(x), int(lost.sum()))]
            norm = np.linalg.norm(sums, axis=1)
        c = sums / norm[:, None]
    return c


class Cells:
    """Centroids, in a tree of two levels if there are many, and the borders within which vectors visit other cells."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, spread: float | None):
        if k <= COARSE:
            self.coarse, self.fine = None, spherical_kmeans(sample, k)
        else:
            self.coarse = spherical_kmeans(sample, round(math.sqrt(k)))
            own = np.concatenate([np.argmax(sample[t] @ self.coarse.T, axis=1) for t in _tiles(len(sample))])
            parts = [spherical_kmeans(sample[own == c], max(1, round(k * float(np.mean(own == c))))) if np.any(own == c) else self.coarse[c : c + 1] for c in range(len(self.coarse))]
            self.fine, self.edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.exact = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
        self.width = self.exact
        if spread is not None and cosine > 0:
            # directions that vectors really take inside their cells
            own = np.concatenate([np.argmax(sample[t] @ self.fine.T, axis=1) for t in _tiles(min(len(sample), SAMPLE))])
            rest = sample[: len(own)] - self.fine[own]
            spectrum = np.linalg.eigvalsh(rest.T @ rest)
            free = spectrum.sum() ** 2 / max(np.square(spectrum).sum(), 1e-300) - 1
            if free > 0:
                self.width = min(self.exact, spread * math.sqrt(max(0.0, 1 - cosine * cosine)) / cosine / math.sqrt(free))

    def _near(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The closest of c to each x, and the pairs of rows of x and c within the borders, that one left out."""
        dots = x @ c.T
        home = np.argmax(dots, axis=1)
        best = dots[np.arange(len(x)), home]
        row, cell = np.nonzero(best[:, None] - dots <= 2 * self.width)
        return home, *self._inside(x, c, row, cell, home, best[row] - dots[row, cell])

    def _inside(self, x, c, row, cell, home, gap) -> tuple[np.ndarray, np.ndarray]:
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", c[home[row]], c[cell])))
        keep = (cell != home[row]) & (gap <= self.width * apart)
        return row[keep], cell[keep]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each row, and the other cells that rows visit, as pairs in order of rows."""
        if self.coarse is None:
            return self._near(x, self.fine)
        top, row, cell = self._near(x, self.coarse)
        row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([top, cell])
        best, home, seen = np.full(len(x), -2.0), np.zeros(len(x), np.int64), []
        for c in np.unique(cell).tolist():
            own, (low, high) = row[cell == c], self.edges[c : c + 2]
            dots = x[own] @ self.fine[low:high].T
            at = np.argmax(dots, axis=1)
            most = dots[np.arange(len(own)), at]
            better = most > best[own]
            best[own[better]], home[own[better]] = most[better], low + at[better]
            seen.append((own, low, dots))
        rows, cells, gaps = [], [], []
        for own, low, dots in seen:
            gap = best[own][:, None] - dots
            r, c = np.nonzero(gap <= 2 * self.width)
            rows.append(own[r])
            cells.append(low + c)
            gaps.append(gap[r, c])
        row, cell = self._inside(x, self.fine, np.concatenate(rows), np.concatenate(cells), home, np.concatenate(gaps)) if rows else (row, cell)
        order = np.argsort(row, kind="stable")
        return home, row[order], cell[order]


def _scan(shared, first: dict[int, int]):
    """first: for each length the number of its first cell; lengths without centroids have that one cell."""
    names = ["id", "key", "unit", "home", "visits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                linked = np.zeros(part.num_rows, bool)
                valid = part["id"].is_valid().to_numpy(zero_copy_only=False)
                lengths = part["embedding"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths[lengths > 0]).tolist():
                    rows = np.flatnonzero((lengths == dim) & valid)
                    x, ok = unit_rows(part["embedding"].take(pa.array(rows)), dim)
                    rows, x = rows[ok], x[ok]
                    linked[rows] = True
                    cells = shared.value.get(dim)
                    home, row, cell = cells.visits(x) if cells is not None else (np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                    edges = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                    raw = [v.tobytes() for v in x]
                    keys = [hashlib.blake2b(b, digest_size=16).digest() for b in raw]
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(raw, pa.binary()), pa.array((first[dim] + home).astype(np.int32)), pa.ListArray.from_arrays(edges, pa.array((first[dim] + cell).astype(np.int32)))], names)
                rest = part["id"].take(pa.array(np.flatnonzero(~linked)))
                n = len(rest)
                yield pa.RecordBatch.from_arrays([rest, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.list_(pa.int32()))], names)

    return run


def _tiles(n: int) -> list[slice]:
    return [slice(k, min(k + TILE, n)) for k in range(0, n, TILE)]


def _labels(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id connected with each row and column through the block's links; own id if there are none."""
    top = np.iinfo(np.int64).max
    r, c = rows.copy(), cols.copy()
    while True:
        new_r, new_c = r.copy(), c.copy()
        for t in _tiles(len(r)):
            new_r[t] = np.minimum(r[t], np.where(linked[t], c[None, :], top).min(axis=1, initial=top))
            new_c = np.minimum(new_c, np.where(linked[t], new_r[t][:, None], top).min(axis=0, initial=top))
        if np.array_equal(new_r, r) and np.array_equal(new_c, c):
            return r, c
        r, c = new_r, new_c


def _blocks(cosine: float):
    def block(x: dict) -> pa.RecordBatch | None:
        own = x["side"] == 0
        other = ~own
        if not own.any() or not other.any():
            return None
        dim = len(x["unit"][0]) // 8  # a cell has vectors of one length
        a = np.frombuffer(b"".join(x["unit"][own]), np.float64).reshape(-1, dim)
        b = np.frombuffer(b"".join(x["unit"][other]), np.float64).reshape(-1, dim)
        ia, ib = x["id"][own], x["id"][other]
        linked = np.empty((len(a), len(b)), bool)
        for t in _tiles(len(a)):
            linked[t] = (a[t] @ b.T >= cosine) & (ia[t, None] != ib[None, :])
        ra, rb = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(ra):
            return None
        linked, ia, ib = linked[np.ix_(ra, rb)], ia[ra], ib[rb]
        ca, cb = x["copies"][own][ra].astype(np.float64), x["copies"][other][rb].astype(np.float64)
        n, m = np.empty(len(ra), np.int64), np.zeros(len(rb), np.int64)
        for t in _tiles(len(ra)):
            n[t] = np.rint(linked[t] @ cb)
        # a link counts for the visitor too, unless it is found once more, in the visitor's cell
        cell, homes = x["cell"][0], x["home"][other][rb]
        visits = x["visits"][own][ra]
        row, seen = np.repeat(np.arange(len(ra)), [len(v) for v in visits]), np.concatenate(visits)
        for home in np.unique(homes[homes != cell]).tolist():
            alone = np.ones(len(ra))
            alone[row[seen == home]] = 0
            at = np.flatnonzero(homes == home)
            m[at] = np.rint((alone * ca) @ linked[:, at])
        r, c = _labels(linked, ia, ib)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ia, ib])), pa.array(np.concatenate([r, c])), pa.array(np.concatenate([n, m]))], ["id", "top", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "side", "id", "copies", "unit", "home", "visits")}
            held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
            edge = np.flatnonzero((np.diff(held["cell"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
            for s, e in zip([0, *edge[:-1].tolist()], edge.tolist()):
                if (out := block({c: v[s:e] for c, v in held.items()})) is not None:
                    yield out
            if len(edge):
                held = {c: v[edge[-1] :] for c, v in held.items()}
        if held is not None and len(held["id"]) and (out := block(held)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, spread: float | None = SPREAD) -> DataFrame:
    """(id, n_links, component, kept) for every row of vectors; ids are integers.

    Null or zero vectors, ones with null or non-finite components, and rows with a null id link with nothing; vectors
    of each length are compared among themselves. Equal vectors are compared once and count as links of each other. Each row
    counts for itself, also where ids repeat. kept: the id is the smallest of its component. An empty table gives no
    rows; other columns, labels among them, are not read. With spread None, and in tables of one cell, all links are
    found; else nearly all, each counted once at both its ends.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    by_length = own.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    by_length = by_length.where("dim > 0").orderBy("dim").collect()  # a row per length
    centroids, first, n_cells = {}, {}, 0
    for dim, total in by_length:
        k = int(min(total // CELL, CENTROID_BYTES // (8 * dim)))
        if k > 1:
            most = max(1, min(max(SAMPLE, SAMPLE_EACH * k), SAMPLE_BYTES // (8 * dim)))
            chosen = own.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(max(1, total // most))) == 0).where(F.size("embedding") == dim).limit(2 * most).toArrow()
            x, ok = unit_rows(chosen["embedding"], dim)
            centroids[dim] = Cells(x[ok] if ok.any() else np.eye(1, dim), k, cosine, spread)
        first[dim], n_cells = n_cells, n_cells + (len(centroids[dim].fine) if dim in centroids else 1)
    centroids = spark.sparkContext.broadcast(centroids)

    scanned = cut(own.mapInArrow(_scan(centroids, first), "id bigint, key binary, unit binary, home int, visits array<int>"), "vectors")
    reps = scanned.where("home >= 0").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # groups go by numbers of their own, as rows of one id may hold different vectors
    reps = cut(reps.withColumn("num", F.monotonically_increasing_id()), "vector-groups")
    once = scanned.join(reps.select(F.col("key").alias("k"), "rep", "copies", "num"), (F.col("id") == F.col("rep")) & (F.col("key") == F.col("k"))).select(F.col("num").alias("id"), "unit", "home", "visits", "copies")
    once = cut(once.dropDuplicates(["id"]), "vector-representatives")  # rows of one id and vector are alike
    homes = once.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("rows"))
    seen = once.select(F.explode(F.concat(F.array("home"), "visits")).alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / COLS).alias("cols"))
    cells = F.broadcast(homes.join(seen, "cell"))  # a row per cell; CENTROID_BYTES bounds them
    part = F.xxhash64(F.lit(3), "id")
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<int>")
    rows = once.join(cells, F.col("home") == F.col("cell")).select("cell", F.pmod(part, "rows").alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"), "id", "copies", "unit", "home", "visits")
    visiting = once.select("id", "copies", "unit", "home", F.explode(F.concat(F.array("home"), "visits")).alias("at"))
    cols = visiting.join(cells, F.col("at") == F.col("cell")).select("cell", F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i"), F.pmod(part, "cols").alias("j"), F.lit(1).alias("side"), "id", "copies", "unit", "home", none.alias("visits"))
    dealt = rows.union(cols).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = cut(dealt.mapInArrow(_blocks(cosine), "id bigint, top bigint, links bigint"), "vector-links")
    drop(once)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("top").alias("b")))
    groups = reps.join(links, F.col("num") == F.col("id"), "left").drop("id").join(joined, F.col("num") == F.col("node"), "left")
    groups = cut(groups.withColumn("part", F.coalesce("component", "num")).drop("component"), "vector-parts")
    least = groups.groupBy(F.col("part").alias("p")).agg(F.min("rep").alias("component"))
    groups = groups.join(least, F.col("part") == F.col("p"))
    groups = groups.select(F.col("key").alias("k"), (F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"), "component")
    out = scanned.select("id", "key").join(groups, F.col("key") == F.col("k"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", zero).alias("n_links"), component.alias("component"), (F.col("id") == component).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("component", "component_id")


OP6_SQL = r"""
with recursive v as (
  select vec_id, embedding::double[] e, list_dot_product(embedding::double[], embedding::double[]) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
unit as (select vec_id, e, q from v where q > 0),
links as (select a.vec_id x, b.vec_id y from unit a, unit b where a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.95 * sqrt(a.q * b.q)),
reach as (
  select vec_id x, vec_id y from embeddings
  union
  select reach.x, links.y from reach join links on links.x = reach.y)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept
from embeddings left join (select x vec_id, count(*) n from links group by x) using (vec_id)
join (select x vec_id, min(y) component_id from reach group by x) using (vec_id)
"""
