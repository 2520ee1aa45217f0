"""Near-duplicate vectors by E8 lattice hashing.

In each of several tables a unit vector is projected at random to blocks of eight
dimensions, and each block is decoded to its nearest point of the lattice E8.  The
points name the vector's home cell.  A vector also probes the neighbouring cells that
lie next nearest to it.  Two vectors are compared where one is at home and the other
is at home or probes; the cosine is then computed in double precision.

Equal vectors are one entry of the index.  The vectors of a crowded home cell that lie
within half the greatest angle of a link around their mean are a ball: all of them link,
so they are counted without being paired.  A ball meets the cells of its members as one
entry.  Its angle to another ball or vector tells whether all pairs link or none does;
only where that is open their members are compared.

What no ball holds is compared cell by cell; a cell of many is cut into blocks, and
tasks compare a block with a block: they return link counts and a spanning forest of
the links, never the links themselves.  A pair that meets in many cells is counted in
the first of them only.
"""

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.components import components
from tidewarden.sources.stage import stage

#: Tables, lattice blocks of a cell, scale of the projection, probed cells per table.
TABLES, BLOCKS, SCALE, PROBES = 6, 2, 0.7, 12
#: Vectors of one cell that a task compares with each other at once.
BLOCK = 256
#: More vectors than this at home in one cell make a ball, where they lie close enough.
CROWD = 64
#: Angles (radians) this close to a bound are settled by cosines.
_MARGIN = 1e-6
_NEAREST, _STEP = 7, 200_000


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, by their definition, and the zero vector last."""
    whole = [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
    half = [v for v in itertools.product((-.5, .5), repeat=8) if sum(v) % 2 == 0]
    return np.array([*whole, *half, (0,) * 8])


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the worst rounding is turned."""
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    off = x[odd] - out[odd]
    worst = np.abs(off).argmax(axis=1)
    out[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return out


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the integer points of even sum, or those moved by one half."""
    a, b = _even(x), _even(x - .5) + .5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Lattice:
    """Cells of unit vectors; the same for every task, from a seed."""

    def __init__(self, tables: int, blocks: int, scale: float, probes: int, seed: int = 8):
        self.tables, self.blocks, self.scale, self.probes, self.seed = tables, blocks, scale, probes, seed

    @lru_cache
    def _drawn(self, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rnd = np.random.default_rng([self.seed, dims])
        planes = rnd.normal(size=(self.tables, dims, 8 * self.blocks)) * self.scale
        factors = rnd.integers(1, 2 ** 63, size=(self.tables, 8 * self.blocks), dtype=np.int64) | 1
        return planes, factors, rnd.integers(0, 2 ** 63, size=self.tables, dtype=np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) cell names; the home cell comes first."""
        n, dims = unit.shape
        planes, factors, salt = self._drawn(dims)
        near = neighbours()
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            at = unit @ planes[t]
            cost, name = np.zeros((n, 1)), np.full((n, 1), salt[t])
            for b in range(self.blocks):
                x, f = at[:, 8 * b:8 * b + 8], factors[t, 8 * b:8 * b + 8]
                point = nearest_point(x)
                # Distance of x from a neighbour of its point, less that from the point itself.
                more = 2 - 2 * (x - point) @ near[:-1].T
                some = np.argpartition(more, _NEAREST, axis=1)[:, :_NEAREST]
                steps = np.concatenate([np.full((n, 1), len(near) - 1), some], axis=1)
                added = np.concatenate([np.zeros((n, 1)), np.take_along_axis(more, some, 1)], axis=1)
                moves = (2 * near).astype(np.int64) @ f  # points doubled are integers; overflow wraps
                names = ((2 * point).astype(np.int64) @ f)[:, None] + moves[steps]
                cost = (cost[:, :, None] + added[:, None, :]).reshape(n, -1)
                name = (name[:, :, None] + names[:, None, :]).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :1 + self.probes]
            out[:, t] = np.take_along_axis(name, best, 1)
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix of doubles with unit rows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of the largest and smallest floats stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cell_rows(classes: DataFrame, lattice: Lattice) -> DataFrame:
    """(t, cell, id, home) for the home and the probed cells of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                for at in range(0, part.num_rows, 1000):
                    piece = part.slice(at, 1000)
                    cells = lattice.cells(_vectors(piece.column(1)))
                    n, tables, each = cells.shape
                    home = np.zeros(cells.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.broadcast_to(np.arange(tables, dtype=np.int32)[:, None], cells.shape).ravel()),
                         pa.array(cells.ravel()),
                         pa.array(np.repeat(piece.column(0).to_numpy(), tables * each)), pa.array(home.ravel())],
                        names=["t", "cell", "id", "home"])

    return classes.select("id", "vector").mapInArrow(run, "t int, cell long, id long, home boolean")


def _first_meeting(a: np.ndarray, b: np.ndarray, t: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether (t, cell) is the first cell in which the vectors with cells ``a`` and ``b`` meet."""
    none = np.iinfo(np.int64).max
    meets = np.minimum(np.where((b == a[:, :, :1]).any(axis=2), a[:, :, 0], none),
                       np.where((a == b[:, :, :1]).any(axis=2), b[:, :, 0], none))
    first = (meets != none).argmax(axis=1)
    return (first == t) & (meets[np.arange(len(a)), first] == cell)


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j inside each run of rows."""
    ends = np.repeat(starts + sizes, sizes)
    i = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)])
    after = ends - i - 1
    first = np.repeat(i, after)
    return first, first + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Links that connect what all links connect, at most one for each node."""
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            out.append((x, y))
    return [x for x, _ in out], [y for _, y in out]


def _compare(lattice: Lattice, least: float):
    """Compares the rows of each (cell, block, block); gives link counts (b null) and links (n null)."""
    def some(ids, copies, side, home, t, cell, unit, cells, i, j):
        keep = (home[i] | home[j]) & ((side[i] != side[j]) | (side[i] == 2))
        i, j = i[keep], j[keep]
        hit = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        i, j = i[hit], j[hit]
        if len(i):
            # Rows of a ball (table -1) meet there only.
            first = (t[i] < 0) | _first_meeting(cells[i], cells[j], t[i], cell[i])
            i, j = i[first], j[first]
        if not len(i):
            return None
        nodes, at = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([copies[j], copies[i]])).astype(np.int64)
        a, b = _forest(ids[i], ids[j])
        return pa.RecordBatch.from_arrays(
            [pa.array([*nodes.tolist(), *a], pa.int64()), pa.array([*([None] * len(nodes)), *b], pa.int64()),
             pa.array([*counts.tolist(), *([None] * len(a))], pa.int64())], names=["a", "b", "n"])

    def whole_groups(batch):
        column = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        plain = {k: column[k].to_numpy(zero_copy_only=False) for k in ("t", "cell", "i", "j", "id", "copies", "side", "home")}
        group = np.stack([plain[k] for k in ("t", "cell", "i", "j")], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(group)))
        lengths = np.asarray(column["vector"].value_lengths())
        assert (lengths == lengths[0]).all() if len(lengths) else True
        unit = _vectors(column["vector"])
        # Each vector's cells once, however many rows it has here.
        _, one, back = np.unique(plain["id"], return_index=True, return_inverse=True)
        cells = np.concatenate([lattice.cells(unit[one[k:k + 1000]]) for k in range(0, len(one), 1000)])
        work = np.cumsum(sizes * (sizes - 1) // 2)
        cuts = np.searchsorted(work, np.arange(0, work[-1] + _STEP, _STEP)[1:], side="left") + 1
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            if lo < min(hi, len(starts)):
                i, j = _pairs(starts[lo:hi], sizes[lo:hi])
                # cells[back] is not built whole: rows look their vector's cells up by number.
                out = some(plain["id"], plain["copies"], plain["side"], plain["home"], plain["t"], plain["cell"],
                           unit, _Lookup(cells, back), i, j)
                if out is not None:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if kept is not None:
                batch = pa.concat_batches([kept, batch])
            keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("t", "cell", "i", "j", "dims")], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = int(change[-1]) if len(change) else 0
            dims = keys[:last, 4]
            for d in np.unique(dims):
                yield from whole_groups(batch.slice(0, last).filter(pa.array(dims == d)))
            kept = batch.slice(last)
        if kept is not None:
            yield from whole_groups(kept)

    return run


class _Lookup:
    def __init__(self, cells, back):
        self.cells, self.back = cells, back

    def __getitem__(self, rows):
        return self.cells[self.back[rows]]


def _with_angle(pairs: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """``keep`` and the angle between the vectors ``a`` and ``b`` of each row; rows of unequal lengths go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(0).value_lengths())
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                apart = np.linalg.norm(_vectors(part.column(0)) - _vectors(part.column(1)), axis=1)
                angle = 2 * np.arcsin(np.minimum(apart / 2, 1))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(angle)], names=[*keep, "angle"])

    same = pairs.filter(F.size(a) == F.size(b)).select(a, b, *keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in same.schema.fields[2:])
    return same.mapInArrow(run, f"{schema}, angle double")


def _means(rows: DataFrame) -> DataFrame:
    """(cell, dims, centre): sums of the unit vectors of each cell, added up by batches first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                names, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(names), dims))
                np.add.at(sums, at, _vectors(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(np.full(len(names), dims, np.int32)), pa.array(list(sums))],
                    names=["cell", "dims", "part"])

    parts = rows.select("cell", "vector").mapInArrow(run, "cell long, dims int, part array<double>")
    return (parts.select("cell", "dims", F.posexplode("part").alias("at", "x"))
            .groupBy("cell", "dims", "at").agg(F.sum("x").alias("x"))
            .groupBy("cell", "dims").agg(F.sort_array(F.collect_list(F.struct("at", "x")))["x"].alias("centre")))


def _balls(cells: DataFrame, classes: DataFrame, tables: int, reach: float, crowd: int) -> tuple[DataFrame, DataFrame] | None:
    """(id, copies, ball) of the vectors in balls and (ball, centre, r, weight, n) of the balls; None without any.

    Table after table, what is in no ball yet and crowds a home cell is measured from its
    mean.  Both are written tables.
    """
    members = balls = None
    for t in range(tables):
        home = cells.filter((F.col("t") == t) & F.col("home")).select("cell", "id")
        if members is not None:
            home = home.join(members, "id", "left_anti")
        full = stage(home.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("cell"))
        if full.isEmpty():
            continue
        rows = stage(home.join(full, "cell").join(classes, "id").withColumn("dims", F.size("vector")))
        means = stage(_means(rows))
        inside = _with_angle(rows.join(means, ["cell", "dims"]), "vector", "centre", "cell", "dims", "id", "copies")
        inside = stage(inside.filter(F.col("angle") <= reach / 2 - _MARGIN))
        named = stage(inside.groupBy("cell", "dims").agg(
            F.min("id").alias("ball"), F.max("angle").alias("r"), F.sum("copies").alias("weight"), F.count("*").alias("n")))
        more = inside.join(named, ["cell", "dims"]).select("id", "copies", "ball")
        made = named.join(means, ["cell", "dims"]).select("ball", "centre", "r", "weight", "n")
        members = stage(more if members is None else members.unionByName(more))
        balls = stage(made if balls is None else balls.unionByName(made))
    return None if balls is None or balls.isEmpty() else (members, balls)


def _ball_links(cells: DataFrame, classes: DataFrame, members: DataFrame, balls: DataFrame, reach: float,
                block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of balls: (id, n) and links (a, b) that need no pairs, and block rows of what is left open."""
    ball_cells = cells.join(members.select("id", "ball"), "id").groupBy("t", "cell", "ball").agg(F.max("home").alias("home"))
    others = (cells.join(members, "id", "left_anti").select("t", "cell", F.col("id").alias("obj"), F.col("home").alias("at_home"))
              .withColumn("many", F.lit(False)).unionByName(
                  ball_cells.select("t", "cell", F.col("ball").alias("obj"), F.col("home").alias("at_home"), F.lit(True).alias("many"))))
    met = (ball_cells.join(others, ["t", "cell"]).filter("(home OR at_home) AND (NOT many OR ball < obj)")
           .select("ball", "obj", "many").distinct())
    alone = classes.select(F.col("id").alias("obj"), F.lit(False).alias("many"), F.col("vector").cast("array<double>").alias("at"),
                           F.lit(0.0).alias("r_o"), F.col("copies").alias("w_o"))
    things = alone.unionByName(balls.select(F.col("ball").alias("obj"), F.lit(True).alias("many"), F.col("centre").alias("at"),
                                            F.col("r").alias("r_o"), F.col("weight").alias("w_o")))
    judged = stage(_with_angle(met.join(things, ["obj", "many"]).join(balls, "ball"), "at", "centre",
                               "ball", "obj", "many", "r", "r_o", "weight", "w_o"))
    wide = F.col("r") + F.col("r_o")
    every = F.col("angle") + wide <= reach - _MARGIN
    near = judged.filter(every)
    unclear = judged.filter(~every & (F.col("angle") - wide <= reach + _MARGIN))

    added = (near.select(F.col("ball").alias("obj"), F.lit(True).alias("many"), F.col("w_o").alias("n"))
             .unionByName(near.select("obj", "many", F.col("weight").alias("n")))
             .groupBy("obj", "many").agg(F.sum("n").alias("n")))
    of_balls = added.filter("many").select(F.col("obj").alias("ball"), F.col("n").alias("more"))
    counts = (members.join(balls.select("ball", "weight"), "ball").join(of_balls, "ball", "left")
              .select("id", (F.col("weight") - F.col("copies") + F.coalesce("more", F.lit(0))).alias("n"))
              .unionByName(added.filter("NOT many").select(F.col("obj").alias("id"), "n")))
    links = members.select(F.col("id").alias("a"), F.col("ball").alias("b")).unionByName(
        near.select(F.col("ball").alias("a"), F.col("obj").alias("b")))

    inside = members.select("id", F.col("ball").alias("obj"))
    guests = stage(unclear.filter("many").join(inside, "obj").select("ball", "id").unionByName(
        unclear.filter("NOT many").select("ball", F.col("obj").alias("id"))))
    parts = (guests.groupBy("ball").agg(F.ceil(F.count("*") / block).alias("guest_parts"))
             .join(balls.select("ball", F.ceil(F.col("n") / block).alias("own_parts")), "ball"))

    def dealt(rows, own, other, side):
        place = F.pmod(F.xxhash64("id"), F.col(own))
        across = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        i, j = (place, across) if side == 0 else (across, place)
        return rows.join(parts, "ball").select(F.lit(-1).alias("t"), F.col("ball").alias("cell"), "id", F.lit(True).alias("home"),
                                               i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    rows = dealt(members.select("ball", "id"), "own_parts", "guest_parts", 0).unionByName(
        dealt(guests, "guest_parts", "own_parts", 1))
    return counts, links, rows


def vector_links(vectors: DataFrame, least: float = 0.95, lattice: Lattice | None = None, block: int = BLOCK,
                 id_col: str = "vec_id", vector_col: str = "embedding", crowd: int = CROWD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Links join rows with a cosine of ``least`` or more, found through the lattice.  A
    vector that is null, empty, zero or holds a null or non-finite number links with
    nothing; vectors of different lengths never link.  Rows that repeat an id and its
    vector count once.  A null id gives n_links 0, a null component and kept false.
    """
    lattice = lattice or Lattice(TABLES, BLOCKS, SCALE, PROBES)
    all_ = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).distinct()
    sound = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    all_ = stage(all_.withColumn("sound", F.coalesce(sound, F.lit(False))))
    classes = stage(all_.filter("sound").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))

    cells = stage(_cell_rows(classes, lattice))
    balls = _balls(cells, classes, lattice.tables, math.acos(least), crowd)
    loose = cells if balls is None else stage(cells.join(balls[0], "id", "left_anti"))
    met = (loose.groupBy("t", "cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home"))
           .filter("n > 1 AND any_home").select("t", "cell", F.ceil(F.col("n") / block).alias("parts")))
    rows = (loose.join(met, ["t", "cell"])
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("t", "cell", "id", "home", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                    F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side")))
    if balls is not None:
        sure, bound, open_ = _ball_links(cells, classes, *balls, math.acos(least), block)
        rows = rows.unionByName(open_)
    full = rows.join(classes.withColumn("dims", F.size("vector")), "id").repartition("t", "cell", "i", "j", "dims")
    found = stage(full.sortWithinPartitions("t", "cell", "i", "j", "dims")
                  .mapInArrow(_compare(lattice, least), "a long, b long, n long"))
    counted, links = found.filter("b IS NULL").select(F.col("a").alias("id"), "n"), found.filter("b IS NOT NULL").select("a", "b")
    if balls is not None:
        counted, links = counted.unionByName(sure), links.unionByName(bound)
    counts = counted.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(links)
    named = (classes.join(counts, "id", "left").join(groups, "id", "left")
             .select("vector", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id"), F.lit(True).alias("sound")))
    return (all_.join(named, ["vector", "sound"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def query(spark, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
