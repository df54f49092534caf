"""Pearson correlation of all pairs of nodes, and graphs of fixed density.

Pairs are worked out in blocks: nodes are dealt into blocks by id, a block of rows meets each block not before
it, and a pair of blocks is worked out in one task, a product of tiles of standardised matrices after another. A block goes
out once for each block it meets, and there are a dozen blocks as long as a task can hold two: up to 48 million numbers
what is shuffled grows with the nodes, from there on with nodes times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import positive_int
from ..functions.tables import cut, small

#: Nodes of a block at least. A graph has BLOCKS blocks at most, as each block goes out once for each, unless one would
#: hold more than BLOCK_VALUES numbers, which is what a task's memory goes with.
BLOCK, BLOCKS, BLOCK_VALUES = 512, 12, 4_000_000
#: Nodes by nodes of a product that is looked at at once.
TILE = 1024
#: Rows of a product whose pairs are counted at once, so that they stay in a core's own memory.
STRIP = 64
#: Binary digits of a band's number in its block; a band is the TILE nodes of a block that a tile has as rows or columns.
BANDS = 20
#: Tasks for each core that pairs of blocks are dealt to.
TASKS_A_CORE = 4
#: Numbers of a vector up to which products are screened in single precision, and numbers that are gathered for single pairs at once.
SINGLE, GATHERED = 2048, 2_000_000
#: Decimals that correlations are rounded to before they are ranked, so that equal ones tie.
DECIMALS = 9


def as_vectors(cells: DataFrame, keys: list[str] | None = None, order: str = "frame") -> DataFrame:
    """(keys, node_id, v) with v the node's values in order."""
    g = cells.groupBy(*(keys or []), "node_id").agg(F.sort_array(F.collect_list(F.struct(order, "v"))).alias("__x"))
    return g.select(*(keys or []), "node_id", F.col("__x.v").alias("v"))


def standardised(m: np.ndarray) -> np.ndarray:
    """Rows less their means, of length 1; constant rows (and those with NaN) become 0."""
    m = m - m.mean(axis=1, keepdims=True)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        m = m / norm
    m[~np.isfinite(m).all(axis=1) | (norm[:, 0] <= 1e-12)] = 0.0
    return m


def in_blocks(rows: DataFrame, keys: list[str], block: int, least, of_key: DataFrame | None = None) -> DataFrame:
    """rows (keys, node_id, ...) once for each pair of blocks that theirs (__b) is in: __lo and __hi. A key has BLOCKS blocks of block nodes at most, but least at least.

    of_key (keys, ...) is a row a key whose further columns come along.
    """
    few = F.least(F.ceil(F.count("*") / block), F.lit(BLOCKS))
    n = rows.groupBy(*keys).agg(F.greatest(few, least).cast("long").alias("__blocks"))
    if of_key is not None:
        n = n.join(of_key, keys) if keys else n.crossJoin(of_key)  # a row each
    own = rows.join(n, keys) if keys else rows.crossJoin(F.broadcast(n))
    own = own.withColumn("__b", F.pmod(F.xxhash64("node_id"), F.col("__blocks")))
    # block b meets b..last as the earlier one and 0..b as the later one
    met = own.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return met.withColumn("__lo", F.least("__b", "__o")).withColumn("__hi", F.greatest("__b", "__o"))


#: A code that stands for so many places without one of those that are coded.
SKIP = 255


def coded(at: np.ndarray, size: int) -> bytes:
    """Sorted places among size of them: a byte for each, how many lie between it and the one before; or, if that is shorter, a bit for each of all."""
    between = np.diff(at, prepend=-1) - 1
    skips = between // SKIP
    n = len(at) + int(skips.sum())
    if n >= -(-size // 8):
        which = np.zeros(size, bool)
        which[at] = True
        return np.packbits(which).tobytes()
    out = np.full(n, SKIP, np.uint8)
    out[np.arange(len(at)) + np.cumsum(skips)] = between - SKIP * skips
    return out.tobytes()


def places(code: bytes, size: int) -> np.ndarray:
    """The places that coded() was given."""
    x = np.frombuffer(code, np.uint8)
    if len(x) >= -(-size // 8):
        return np.flatnonzero(np.unpackbits(x, count=size))
    own = x != SKIP
    at = np.cumsum(x, dtype=np.int64)
    return at + np.arange(len(x)) if own.all() else (at + np.cumsum(own) - 1)[own]


def _products(vectors: DataFrame, keys: list[str], block: int, make: Callable[..., Iterator[pd.DataFrame]], ddl: str, of_key: DataFrame | None = None) -> DataFrame:
    """What make(first row, tiles) yields for each pair of blocks, after the keys' columns.

    A tile is (rows, other rows, r, counted): positions among the rows of the pair of blocks, which are tiles.rows, and the
    rounded r between them; counted is None if each of its pairs is one of nodes, else the mask of those that are, each once.
    of_key (keys, ...) is a row a key whose further columns come along, as do those of vectors.
    """
    block = positive_int(block, "block", 2)
    met = in_blocks(vectors, keys, block, F.ceil(F.count("*") * F.max(F.size("v")) / BLOCK_VALUES), of_key)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("node_id", ignore_index=True)  # the same sums in each pass
        first = pdf.iloc[0]
        tiles = _Tiles(pdf, int(first["__lo"]), int(first["__hi"]))
        for out in make(first, tiles) if tiles.whole else ():
            for k in reversed(keys):
                out.insert(0, k, first[k])
            yield out

    more = [c for c in (of_key.columns if of_key is not None else []) if c not in keys]
    also = [c for c in vectors.columns if c not in (*keys, "node_id", "v")]
    out_ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), ddl])
    met = met.select(*keys, "node_id", "v", *also, "__b", "__lo", "__hi", *more)
    # the work is the pairs, not the bytes that Spark would join partitions by
    tasks = TASKS_A_CORE * met.sparkSession.sparkContext.defaultParallelism
    return met.repartition(tasks, *keys, "__lo", "__hi").groupBy(*keys, "__lo", "__hi").applyInPandas(product, out_ddl)


class _Tiles:
    """The pairs of two blocks (or of one with itself), TILE by TILE nodes at a time."""

    def __init__(self, pdf: pd.DataFrame, lo: int, hi: int):
        own = pdf["__b"].to_numpy()
        self.a, self.b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        self.same, self.whole = lo == hi, len(self.a) > 0 and len(self.b) > 0
        self.rows = pdf.drop(columns="v")
        self.ids = pdf["node_id"].to_numpy()
        self.x = standardised(np.stack(pdf["v"].to_numpy()).astype(float)) if self.whole else None

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        for p in range(0, len(self.a), TILE):
            for q in range(p if self.same else 0, len(self.b), TILE):
                a, b = self.a[p : p + TILE], self.b[q : q + TILE]
                r = np.round(np.clip(self.x[a] @ self.x[b].T, -1, 1), DECIMALS) + 0.0
                yield a, b, r, np.triu(np.ones(r.shape, bool), 1) if self.same and p == q else None

    def screened(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """The same tiles with r in single precision, which is less than slack off the rounded r."""
        n = self.x.shape[1]
        # twice what sums of n products of rows of length 1 are off at most, and half a last decimal
        self.slack = (n + 8) * float(np.finfo(np.float32 if n <= SINGLE else np.float64).eps) + 10.0**-DECIMALS
        x = self.x.astype(np.float32) if n <= SINGLE else self.x
        for p in range(0, len(self.a), TILE):
            for q in range(p if self.same else 0, len(self.b), TILE):
                a, b = self.a[p : p + TILE], self.b[q : q + TILE]
                r = x[a] @ x[b].T
                yield a, b, np.clip(r, -1, 1, out=r), np.triu(np.ones(r.shape, bool), 1) if self.same and p == q else None

    def exact(self, a: np.ndarray, b: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The rounded r of the pairs of rows a and b in the mask which, in order; few pairs are worked out one by one."""
        at = np.flatnonzero(which)
        p, q = at // which.shape[1], at % which.shape[1]
        if 16 * len(p) > which.size:
            r = (self.x[a] @ self.x[b].T)[p, q]
        else:
            many = max(1, GATHERED // max(1, self.x.shape[1]))
            r = np.concatenate([np.einsum("ij,ij->i", self.x[a[p[k : k + many]]], self.x[b[q[k : k + many]]]) for k in range(0, len(p), many)] or [np.empty(0)])
        return np.round(np.clip(r, -1, 1), DECIMALS) + 0.0


def _as_pairs(tiles: _Tiles, a: np.ndarray, b: np.ndarray, r: np.ndarray, which: np.ndarray | None) -> pd.DataFrame:
    p, q = np.nonzero(np.ones(r.shape, bool) if which is None else which)
    u, v = tiles.ids[a][p], tiles.ids[b][q]
    return pd.DataFrame({"i": np.minimum(u, v), "j": np.maximum(u, v), "r": r[p, q]})


def correlations(vectors: DataFrame, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, i, j, r) for i < j: Pearson's r, clipped to [-1, 1] and rounded; 0 where a node does not vary.

    vectors is (keys, node_id, v), with v of the same length for all nodes of a key. Pairs with r = 0 are rows too.
    """

    def pairs(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        for a, b, r, counted in tiles:
            yield _as_pairs(tiles, a, b, r, counted)

    return _products(vectors.select(*keys or [], "node_id", "v"), keys or [], block, pairs, "i long, j long, r double")


def edges_wanted(n_nodes, density):
    """How many of the pairs of n nodes a density keeps: its floor in double precision, one at least, all at most."""
    possible = n_nodes * (n_nodes - 1) / F.lit(2.0)
    return F.greatest(F.lit(1.0), F.least(F.floor(density * possible).cast("double"), possible)).cast("long")


#: Cells of |r| (or r) from 0 to 1 that pairs are counted in before any is looked at by its value.
CELLS = 10_000


def _check_densities(densities: list[float]) -> None:
    if not densities or any(isinstance(d, bool) or not 0 < d <= 1 for d in densities):
        raise ValueError("densities must lie in (0, 1]")


def _wanted(totals: DataFrame, densities: list[float]) -> DataFrame:
    """(keys, density, __m): how many of the pairs, (keys, __pairs), each density keeps."""
    grid = totals.sparkSession.createDataFrame([(float(d),) for d in densities], "density double")
    m = F.greatest(F.lit(1.0), F.floor(F.col("density") * F.col("__pairs"))).cast("long")
    return totals.crossJoin(F.broadcast(grid)).withColumn("__m", m)


def _at_place(counts: DataFrame, want: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    """want's rows with the value that their place lies in, from the largest on, and __upto and __n of it. counts is (keys, value, __n)."""
    upto = F.sum("__n").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc(value)))
    above = counts.withColumn("__upto", upto)
    both = want.join(above, keys) if keys else want.crossJoin(above)
    return both.where((F.col("__upto") >= F.col(place)) & (F.col("__upto") - F.col("__n") < F.col(place)))


def _cut_cells(coarse: DataFrame, want: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """want's rows (keys, ..., __m) with the cell __b that the place lies in, __rest, its place there, and __pairs. coarse is (keys, __b, __n)."""
    # at most 2 * CELLS + 1 rows a key
    at = _at_place(coarse, want(coarse.groupBy(*keys).agg(F.sum("__n").alias("__pairs"))), keys, "__b", "__m")
    return at.withColumn("__rest", F.col("__m") - (F.col("__upto") - F.col("__n"))).drop("__upto", "__n")


def _kept(pairs: DataFrame, at: DataFrame, keys: list[str], weighted: bool) -> DataFrame:
    """The pairs (keys, i, j, r, __k, __b) down to each density's last one, whose value comes from counts by value in its cell."""
    near = pairs.join(at, [*keys, "__b"]).groupBy(*keys, "density", "__rest", "__k").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "density").orderBy(F.desc("__k")))
    last = near.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__rest")) & (F.col("__upto") - F.col("__n") < F.col("__rest"))).select(*keys, "density", F.col("__k").alias("threshold"))
    last = small(last, "thresholds")  # a row for each graph
    kept = (pairs.join(last, keys) if keys else pairs.crossJoin(last)).where(F.col("__k") >= F.col("threshold"))
    return kept.select(*keys, "density", "i", "j", "r", (F.col("r") if weighted else F.lit(1.0)).alias("w"), "threshold")


def density_graphs(pairs: DataFrame, densities: list[float], negative: bool = True, weighted: bool = False, keys: list[str] | None = None) -> DataFrame:
    """(keys, density, i, j, r, w, threshold): the strongest pairs of each graph at each density, ties with the last included.

    negative ranks by |r|, else by r. One ranking serves all densities. w is r if weighted, else 1. The rank's
    cut-off comes from counts per value, added up from the top: values repeat, pairs need not be sorted in one task.
    pairs are read several times; where they come from vectors, density_graphs_of() needs none of them written.
    """
    _check_densities(densities)
    keys = keys or []
    pairs = pairs.withColumn("__k", F.abs("r") if negative else F.col("r"))
    pairs = pairs.withColumn("__b", F.floor(F.col("__k") * CELLS).cast("long"))
    coarse = cut(pairs.groupBy(*keys, "__b").agg(F.count("*").alias("__n")), "cells")
    at = _cut_cells(coarse, lambda totals: _wanted(totals, densities), keys).select(*keys, "density", "__b", "__rest")
    return _kept(pairs, small(at, "cut-cells"), keys, weighted)


def _strength(r: np.ndarray, negative: bool) -> np.ndarray:
    return np.abs(r) if negative else r


def _places(vectors: DataFrame, want: Callable[[DataFrame], DataFrame], negative: bool, keys: list[str], block: int) -> DataFrame:
    """want's rows (keys, ..., __m) with threshold, the __m-th largest |r| (or r) of all pairs, n_edges, the pairs that have as much, and __pairs.

    Two passes over products of blocks in single precision: the first hands on counts of pairs by cells, the second counts the pairs above the
    cells that a place lies in, and those near them by value, in double precision. No pairs are shuffled or written.
    """

    def by_cell(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        least = 0 if negative else CELLS
        n = np.zeros(least + CELLS + 1, np.int64)
        for _, _, r, counted in tiles.screened():
            for p in range(0, len(r), STRIP):
                k = r[p : p + STRIP] if counted is None else r[p : p + STRIP][counted[p : p + STRIP]]
                k = (np.abs(k) if negative else k) * CELLS
                cell = k.astype(np.int64) if negative else np.floor(k).astype(np.int64) + CELLS
                n += np.bincount(cell.ravel(), minlength=len(n))
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"__b": seen - least, "__n": n[seen]})

    def by_value(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        # a place is off its cell by less than slack; what is above that is one value, infinity
        cells = {int(c): (np.empty(0), np.empty(0), 0) for c in first["__cells"]}
        for a, b, r, counted in tiles.screened():
            k = _strength(r, negative)
            for cell, (values, counts, above) in cells.items():
                lo, hi = cell / CELLS - tiles.slack, (cell + 1) / CELLS + tiles.slack
                sure, near = k > hi + tiles.slack, k >= lo - tiles.slack
                if counted is not None:
                    sure, near = sure & counted, near & counted
                exact = _strength(tiles.exact(a, b, near & ~sure), negative)
                above += np.count_nonzero(sure) + np.count_nonzero(exact > hi)
                found, n = np.unique(exact[(exact >= lo) & (exact <= hi)], return_counts=True)
                values, where = np.unique(np.concatenate([values, found]), return_inverse=True)  # rounded, so they are bounded in number
                cells[cell] = values, np.bincount(where, np.concatenate([counts, n]), len(values)), above
        for cell, (values, counts, above) in cells.items():
            yield pd.DataFrame({"__b": cell, "__k": np.append(values, np.inf), "__n": np.append(counts, above).astype(np.int64)})

    coarse = _products(vectors, keys, block, by_cell, "__b long, __n long").groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"))
    at = small(_cut_cells(cut(coarse, "cells"), want, keys).drop("__rest"), "cut-cells")
    cells = at.groupBy(*keys).agg(F.collect_set("__b").alias("__cells"))
    fine = _products(vectors, keys, block, by_value, "__b long, __k double, __n long", cells).groupBy(*keys, "__b", "__k").agg(F.sum("__n").alias("__n"))
    found = _at_place(cut(fine, "values"), at, [*keys, "__b"], "__k", "__m")
    out = found.withColumn("n_edges", F.col("__upto")).withColumnRenamed("__k", "threshold")
    return small(out.drop("__b", "__m", "__upto", "__n"), "thresholds")  # a row for each graph


def density_counts_of(vectors: DataFrame, densities: list[float], negative: bool = True, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, density, threshold, n_edges, n_pairs) of the graphs of density_graphs_of(), without their edges."""
    _check_densities(densities)
    keys = keys or []
    out = _places(vectors.select(*keys, "node_id", "v"), lambda totals: _wanted(totals, densities), negative, keys, block)
    return out.select(*keys, "density", "threshold", "n_edges", F.col("__pairs").alias("n_pairs"))


def _of_graphs(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __densities, __thresholds), a row a key."""
    rows = F.sort_array(F.collect_list(F.struct("density", "threshold")))
    return counts.groupBy(*keys).agg(rows.alias("__g")).select(*keys, F.col("__g.density").alias("__densities"), F.col("__g.threshold").alias("__thresholds"))


def density_graphs_of(vectors: DataFrame, densities: list[float], negative: bool = True, weighted: bool = False, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """density_graphs() of all pairs of vectors (keys, node_id, v), in three passes over products of blocks.

    Two passes find the thresholds and hand on counts alone (see _places()); the third gives the edges, which are the result and are
    neither shuffled nor written on the way. Whoever reads them more than once writes them.
    """
    keys, vectors = keys or [], vectors.select(*keys or [], "node_id", "v")
    counts = density_counts_of(vectors, densities, negative, keys, block)

    def edges(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        for a, b, r, counted in tiles:
            k = _strength(r, negative)
            for density, threshold in zip(first["__densities"], first["__thresholds"], strict=True):
                which = k >= threshold
                out = _as_pairs(tiles, a, b, r, which if counted is None else which & counted)
                if len(out):
                    out.insert(0, "density", density)
                    yield out.assign(w=out["r"] if weighted else 1.0, threshold=threshold)

    return _products(vectors, keys, block, edges, "density double, i long, j long, r double, w double, threshold double", _of_graphs(counts, keys))


def density_tiles_of(vectors: DataFrame, densities: list[float], negative: bool = True, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, density, a, b, bits, ids, n, threshold): the graphs of density_graphs_of(), without weights, a byte for each edge at most.

    A row is what two bands of up to TILE nodes have of a graph: bits is coded() places among a's nodes by b's, and n its edges. Each band meets
    itself in one row, which has its nodes in order as ids, also in a graph without pairs. The operators in tiles read these rows.
    """
    keys, vectors = keys or [], vectors.select(*keys or [], "node_id", "v")
    counts = density_counts_of(vectors, densities, negative, keys, block)
    grid = F.broadcast(vectors.sparkSession.createDataFrame([(float(x),) for x in densities], "density double"))
    graphs = vectors.groupBy(*keys).agg(F.count("*").alias("__n")).drop("__n").crossJoin(grid).join(counts, [*keys, "density"], "left")
    graphs = graphs.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))

    def edges(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        band = lambda side, own, rows: int(side) << BANDS | int(np.searchsorted(own, rows[0])) // TILE
        for a, b, r, counted in tiles.screened():
            k, ids = _strength(r, negative), None if counted is None else tiles.ids[a].astype(np.int64).tobytes()
            lo, hi, rows = band(first["__lo"], tiles.a, a), band(first["__hi"], tiles.b, b), []
            for density, threshold in zip(first["__densities"], first["__thresholds"], strict=True):
                which, near = k > threshold + tiles.slack, k >= threshold - tiles.slack
                if counted is not None:
                    which, near = which & counted, near & counted
                near &= ~which
                which[near] = _strength(tiles.exact(a, b, near), negative) >= threshold
                rows.append((density, lo, hi, coded(np.flatnonzero(which), which.size), ids, int(np.count_nonzero(which)), threshold))
            yield pd.DataFrame(rows, columns=["density", "a", "b", "bits", "ids", "n", "threshold"])

    return _products(vectors, keys, block, edges, "density double, a long, b long, bits binary, ids binary, n long, threshold double", _of_graphs(graphs, keys))


def density_links_of(vectors: DataFrame, density: float, negative: bool = True, block: int = BLOCK) -> DataFrame:
    """(i, j): links with the components of the graph of a density, less than two for each node and pair of blocks however many edges it has."""
    vectors = vectors.select("node_id", "v")
    counts = density_counts_of(vectors, [density], negative, [], block)

    def links(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        up = np.arange(len(tiles.ids))
        for a, b, r, counted in tiles:
            which = _strength(r, negative) >= first["__thresholds"][0]
            p, q = np.nonzero(which if counted is None else which & counted)
            up = joined(up, a[p], b[q])
        own = np.flatnonzero(up != np.arange(len(up)))
        yield pd.DataFrame({"i": tiles.ids[up[own]], "j": tiles.ids[own]})

    return _products(vectors, [], block, links, "i long, j long", _of_graphs(counts, []))


def joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """up, the least member of each one's component, after links from i to j."""
    while True:
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        up = up.copy()
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def label_modularity_of(vectors: DataFrame, density: float, negative: bool = True, block: int = BLOCK) -> DataFrame:
    """(n_edges, threshold, q): modularity of the labels of vectors (node_id, v, module) on their graph of a density.

    Each pair of blocks hands on the ends and the inner edges of modules, so no edge is written. A null module is one whose edges are not inner.
    """
    vectors = vectors.select("node_id", "v", F.col("module").cast("string").alias("module"))
    counts = density_counts_of(vectors, [density], negative, [], block)

    def ends(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        own, names = pd.factorize(tiles.rows["module"], use_na_sentinel=False)
        deg, inside = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        known = ~pd.isna(names)
        for a, b, r, counted in tiles:
            which = _strength(r, negative) >= first["__thresholds"][0]
            p, q = np.nonzero(which if counted is None else which & counted)
            ma, mb = own[a[p]], own[b[q]]
            deg += np.bincount(ma, minlength=len(names)) + np.bincount(mb, minlength=len(names))
            inside += np.bincount(ma[ma == mb], minlength=len(names))
        yield pd.DataFrame({"module": names, "deg": deg, "inside": np.where(known, inside, 0)})

    per = _products(vectors, [], block, ends, "module string, deg long, inside long", _of_graphs(counts, [])).groupBy("module").agg(F.sum("deg").alias("deg"), F.sum("inside").alias("inside"))
    total = counts.select((2.0 * F.col("n_edges")).alias("two_m"))
    share = 2 * F.col("inside") / F.col("two_m") - F.pow(F.col("deg") / F.col("two_m"), F.lit(2.0))
    q = per.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("q"))
    e = counts.agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"), F.min("threshold").alias("threshold"))
    return e.crossJoin(q)  # a row each


def quantiles_of(vectors: DataFrame, shares: list[float], absolute: bool = False, block: int = BLOCK) -> DataFrame:
    """(q0, q1, ...) in one row: exact quantiles of r (or |r|) over all pairs of vectors (node_id, v), linear between neighbours; null without pairs."""
    wanted = F.array(*[F.struct(F.lit(k).alias("__share"), F.lit(up).alias("__up"), ((F.col("__pairs") - 1) * F.lit(float(s))).alias("__at")) for k, s in enumerate(shares) for up in (0, 1)])

    def want(totals: DataFrame) -> DataFrame:
        rows = totals.select("__pairs", F.inline(wanted))
        return rows.withColumn("__m", F.col("__pairs") - F.when(F.col("__up") == 1, F.ceil("__at")).otherwise(F.floor("__at")))

    found = _places(vectors.select("node_id", "v"), want, absolute, [], block)
    at = lambda k, up: F.max(F.when((F.col("__share") == k) & (F.col("__up") == up), F.col("threshold")))
    part = lambda k: F.max(F.when(F.col("__share") == k, F.col("__at") - F.floor("__at")))
    return found.agg(*[(at(k, 0) + (at(k, 1) - at(k, 0)) * part(k)).alias(f"q{k}") for k in range(len(shares))])


def survival(pairs: DataFrame, grid: list[float]) -> DataFrame:
    """(g, fraction) of |r| that is g or more."""
    counts = pairs.agg(F.count("*").alias("n"), *[F.count_if(F.abs("r") >= g).alias(f"c{k}") for k, g in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(g)).alias("g"), (F.col(f"c{k}") / F.col("n")).alias("fraction")) for k, g in enumerate(grid)])
    return counts.select(F.inline(rows))


def survival_of(vectors: DataFrame, grid: list[float], block: int = BLOCK) -> DataFrame:
    """survival() of all pairs of vectors (node_id, v): each product of blocks hands on one row of counts for each g."""

    def count(first: pd.Series, tiles: _Tiles) -> Iterator[pd.DataFrame]:
        c, n = np.zeros(len(grid), np.int64), 0
        for _, _, r, counted in tiles:
            k = np.abs(r if counted is None else r[counted])
            c, n = c + [int((k >= g).sum()) for g in grid], n + k.size
        yield pd.DataFrame({"g": [float(g) for g in grid], "c": c, "n": n})

    found = _products(vectors.select("node_id", "v"), [], block, count, "g double, c long, n long")
    return found.groupBy("g").agg((F.sum("c") / F.sum("n")).alias("fraction"))
