"""Near-duplicate vectors of one label, found through an inverted multi-index.

Each half of the (normalised) vectors has a codebook of its own; the product of both is
a grid of cells (Babenko, Lempitsky 2012), about ``per_cell`` vectors of the largest
label to a cell. Neighbouring cells lie on one shelf, about ``block`` vectors of the largest
label to a shelf. Every vector is filed on the shelf of its nearest cell, and asks the others
in the order of the multi-sequence traversal, nearest first. A cell's cost is a bound: no
vector in it is nearer than that, by its distance from the planes between the cell's centers
and the asker's own. So the traversal is over, with every neighbour found, where the cost exceeds
the distance at the limit. Of two shelves the lower one's vectors ask, and a link counts
for both ends. All pairs that meet are verified in double precision.

With a ``recall`` below 1 the traversal stops at the cost that reaches as many of a sample's
vectors turned by the limit's angle in random directions: an estimate, and too low
where vectors fill few dimensions of their space.

Codebooks are fitted on at most ``sample`` vectors; every vector is indexed and every
vector asks. Vectors of one label that are equal bit for bit share an index entry with
their count. Shelves are cut into blocks of ``block`` vectors; a block is compared with
those that ask for it as a product of matrices, at most about ``ASKERS`` blocks of them in a
task's group, and returns a count for each vector and one link for each group it joins, never
all pairs. Where the bound excludes little (vectors that fill many dimensions evenly), the
work grows with the square of a label's vectors.

Nulls: vectors that are null, zero, of another length than most, or hold null or
non-finite parts, and those with a null label, link with nothing. A null id is returned
with no links and a null component. Rows that repeat an id are one node; each row
counts the others as links. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import discard, pick, written

TRAIN_SEED = 4
#: Of a half; the grid has the square of it.
MOST_CENTERS = 256
#: Blocks of askers that one block is compared with at a time.
ASKERS = 16
#: Of squared distances and distances of centers: what rounding may change.
SLACK, LEAST_GAP = 1e-6, 1e-6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
    return np.sqrt(np.maximum(square, 0))


def codebook(x: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Centers by Lloyd's rounds; fewer than ``size`` where there are fewer distinct rows."""
    r = np.random.Generator(np.random.PCG64(TRAIN_SEED))
    x = np.unique(x, axis=0)
    centers = x[r.permutation(len(x))[:size]]
    for _ in range(rounds):
        at = _distances(x, centers).argmin(1)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def traversal(one: np.ndarray, two: np.ndarray):
    """Cells (i, j) of a grid with sorted costs ``one[i] + two[j]``, cheapest first (multi-sequence)."""
    import heapq

    heap, out = [(one[0] + two[0], 0, 0)], set()
    while heap:
        cost, i, j = heapq.heappop(heap)
        yield cost, i, j
        out.add((i, j))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a == 0 or (a - 1, b) in out) and (b == 0 or (a, b - 1) in out):
                heapq.heappush(heap, (one[a] + two[b], a, b))


class Grid:
    """Codebooks of both halves, their centers by shelves, and how far the traversal goes."""

    def __init__(self, sample: np.ndarray, size: int, shelves: int):
        self.half = sample.shape[1] // 2
        self.books = [codebook(sample[:, : self.half], size), codebook(sample[:, self.half :], size)]
        self.gaps = [_distances(b, b) for b in self.books]
        self.groups = []
        for book in self.books:
            at = _distances(book, codebook(book, min(shelves, len(book)))).argmin(1)
            self.groups.append(np.unique(at, return_inverse=True)[1])
        self.wide = int(self.groups[1].max()) + 1
        self.stop = np.inf

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each row: its own shelf, and of each half by group of centers: what the squared distance to any vector there is at least."""
        own, out = [], []
        for half, book, gap, group in zip((x[:, : self.half], x[:, self.half :]), self.books, self.gaps, self.groups, strict=True):
            square = _distances(half, book) ** 2
            home = square.argmin(1)
            gap = gap[home]
            # from the plane midway between a center and the nearest one
            far = np.where(gap > LEAST_GAP, (square - square.min(axis=1, keepdims=True)) / (2 * np.maximum(gap, LEAST_GAP)), 0)
            least = np.full((len(x), int(group.max()) + 1), np.inf)
            for center, g in enumerate(group):
                least[:, g] = np.minimum(least[:, g], far[:, center] ** 2)
            own.append(group[home])
            out.append(least)
        return own[0] * self.wide + own[1], out

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.bounds(x)[0]

    def visits(self, x: np.ndarray):
        """Of each row, the shelves from its own on that it asks, nearest first."""
        own, costs = self.bounds(x)
        order = [np.argsort(c, axis=1, kind="stable") for c in costs]
        sorted_costs = [np.take_along_axis(c, o, 1) for c, o in zip(costs, order, strict=True)]
        for r in range(len(x)):
            shelves = []
            for cost, i, j in traversal(sorted_costs[0][r], sorted_costs[1][r]):
                if cost > self.stop:
                    break
                shelf = int(order[0][r, i]) * self.wide + int(order[1][r, j])
                if shelf >= own[r]:
                    shelves.append(shelf)
            yield shelves

    def settle(self, sample: np.ndarray, limit: float, recall: float, turns: int = 4) -> None:
        """Stop where no neighbour can be; with a recall below 1, at the cost that reaches so many of the sample's turned vectors."""
        self.stop = 2 - 2 * limit + SLACK
        if recall >= 1:
            return
        r = np.random.Generator(np.random.PCG64(TRAIN_SEED))
        _, (a, b) = self.bounds(sample)
        rows, found = np.arange(len(sample)), []
        for _ in range(turns):
            aside = r.normal(size=sample.shape)
            aside -= (aside * sample).sum(1, keepdims=True) * sample
            home = self.home(limit * sample + np.sqrt(1 - limit * limit) * _unit(aside))
            found.append(a[rows, home // self.wide] + b[rows, home % self.wide])
        self.stop = min(self.stop, float(np.quantile(np.concatenate(found), recall, method="higher")))


def _place(grid: Grid, width: int):
    """Columns: label, rep, n, v. Adds each vector's own shelf."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x = _unit(_matrix(batch.column("v"), width))
                yield batch.append_column("shelf", pa.array(grid.home(x).astype(np.int64)))

    return run


def _ask(grid: Grid, width: int):
    """A row for each shelf that a vector asks; other: not its own."""

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                shelves = list(grid.visits(_unit(_matrix(part.column("v"), width))))
                at = np.repeat(np.arange(len(part)), [len(c) for c in shelves])
                flat = np.array([c for x in shelves for c in x], np.int64)
                other = pa.array(flat != part.column("shelf").to_numpy()[at])
                columns = [part.column(c).take(pa.array(at)) for c in ("label", "rep", "n", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flat), other], names=["label", "rep", "n", "v", "shelf", "other"])

    return run


def _compare(limit: float, width: int):
    """One block of a shelf and those that ask it: each vector's count of linked ones, and links that join groups.

    Askers of the same shelf are filed there too, and ask in their turn: they count for themselves."""

    def run(filed: pa.Table, asking: pa.Table) -> pa.Table:
        rep, n, a, b = [], [], [], []
        if len(filed) and len(asking):
            own, weight = filed["rep"].to_numpy(), filed["n"].to_numpy()
            y = _unit(_matrix(filed["v"], width))
            group = np.arange(len(own))
            back = np.zeros(len(own), np.int64)
            askers = asking["rep"].to_numpy()
            theirs = asking["n"].to_numpy() * asking["other"].to_numpy(zero_copy_only=False)
            x = _unit(_matrix(asking["v"], width))
            for first in range(0, len(askers), 512):
                ids = askers[first : first + 512]
                linked = (x[first : first + 512] @ y.T >= limit) & (own != ids[:, None])
                counts = linked @ weight
                back += theirs[first : first + 512] @ linked
                for r in np.flatnonzero(counts):
                    rep.append(int(ids[r]))
                    n.append(int(counts[r]))
                    groups, at = np.unique(group[linked[r]], return_index=True)
                    members = own[linked[r]][at]
                    a += [int(ids[r])] * len(members)
                    b += members.tolist()
                    if len(groups) > 1:
                        group[np.isin(group, groups)] = groups[0]
            some = np.flatnonzero(back)
            rep += own[some].tolist()
            n += back[some].tolist()
        none_n, none_l = [None] * len(rep), [None] * len(a)
        return pa.table(
            {
                "rep": pa.array(rep + none_l, pa.int64()),
                "n": pa.array(n + none_l, pa.int64()),
                "a": pa.array(none_n + a, pa.int64()),
                "b": pa.array(none_n + b, pa.int64()),
            }
        )

    return run


def vector_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    limit: float = 0.93,
    per_cell: int = 64,
    recall: float = 1.0,
    sample: int = 4096,
    block: int = 2048,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest id reachable) and kept (vec_id = component_id)."""
    rows = pick(vectors, id=id_col, v=vector_col, label=label_col)
    sound = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    widths = rows.where(sound).groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 0
    alone = rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if width < 2:
        return alone.withColumn("kept", F.lit(True))

    usable = rows.where(sound & (F.size("v") == width))
    classes = written(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    some = classes.orderBy(F.xxhash64("rep"), "rep", "label").limit(sample).select("v").toArrow()
    x = _unit(_matrix(some["v"], width))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    centers = min(max(2, math.ceil(math.sqrt(largest / per_cell))), MOST_CENTERS)
    grid = Grid(x, centers, math.ceil(math.sqrt(largest / block)))
    grid.settle(x, limit, recall)

    kind, parts = dict(classes.dtypes)["label"], dict(classes.dtypes)["v"]
    shelves = classes.mapInArrow(_place(grid, width), f"label {kind}, v {parts}, rep long, n long, shelf long")
    shelves = written(shelves, "shelves")
    sizes = shelves.groupBy("label", "shelf").agg(F.count("*").alias("size"))
    all_of_label = F.sum("size").over(Window.partitionBy("label"))
    sizes = sizes.select(
        "label",
        "shelf",
        F.ceil(F.col("size") / block).cast("int").alias("blocks"),
        F.ceil(all_of_label / (ASKERS * block)).cast("int").alias("parts"),
    )
    filed = (
        shelves.join(sizes, ["label", "shelf"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("label", "shelf", "block", "part", "rep", "n", "v")
    )
    asking = (
        shelves.select("label", "rep", "n", "v", "shelf")
        .mapInArrow(_ask(grid, width), f"label {kind}, rep long, n long, v {parts}, shelf long, other boolean")
        .join(sizes, ["label", "shelf"])
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int"))
        .select("label", "shelf", "block", "part", "rep", "n", "v", "other")
    )
    keys = ["label", "shelf", "block", "part"]
    found = filed.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_compare(limit, width), "rep long, n long, a long, b long")
    found = written(found, "found")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("near"))
    own = usable.join(classes, ["label", "v"])
    copies = own.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    joined = components(found.where("a is not null").select("a", "b").union(copies))
    per_row = (
        own.join(counts, "rep", "left")
        .groupBy("id")
        .agg(F.max(F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    )
    discard(shelves)
    return (
        rows.select("id")
        .join(per_row, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
