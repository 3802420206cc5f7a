"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected to eight dimensions by several random matrices, and each projection is
decoded to the nearest point of the E8 lattice: that point and the label name a cell. A vector
lives in one cell of each table and also probes the cells beyond its nearest Voronoi
facets. Vectors that meet in a cell where at least one of them lives are compared by cosine in
double precision; nothing else is.

Equal vectors of a label are one row with a weight. Only ids go through the counting of cells; vectors follow
to the cells where something can be found. A cell with many rows is cut into blocks, and a
task compares two blocks, so no task holds more than two blocks and no pair is ever a
row: a task returns a count and a link to the smallest id it reaches for each vector. A pair that
meets in several cells is counted in the first of them alone, which a task works out
from the two vectors.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftscan.llm.components import connected_components
from weftscan.llm.runs import whole_runs
from weftscan.llm.store import materialize

#: Tables, probes in each, lattice units for a unit of projected distance, and rows of a block.
TABLES, PROBES, SCALE, BLOCK = 10, 2, 0.8, 32768
#: Cells of at most this many rows are compared many at once, of about this many rows together.
SMALL, ROWS_AT_ONCE = 64, 20_000


@functools.cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((-1.0, 1.0), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if odd re-round the coordinate that was rounded furthest."""
    p = np.rint(y)
    odd = np.flatnonzero(p.sum(1) % 2 != 0)
    off = y[odd] - p[odd]
    k = np.abs(off).argmax(1)
    p[odd, k] += np.where(off[np.arange(odd.size), k] >= 0, 1.0, -1.0)
    return p


def decode_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points of the rows of ``y``: the nearer one of D8 and of D8 moved by 1/2."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


@functools.cache
def _projections(dim: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    return rng.standard_normal((tables, 8, dim)), rng.random((tables, 8))


def _cell_keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of lattice points (in halves) with a salt for each row."""
    h = salt.astype(np.uint64)
    for k in range(8):
        h = (h ^ (points[..., k] * 2).astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h.view(np.int64)


def lattice_cells(unit: np.ndarray, labels: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the home cell (rows, tables) and of the probed cells (rows, tables, probes)."""
    matrices, shifts = _projections(unit.shape[1], tables, seed)
    home = np.empty((len(unit), tables), np.int64)
    probed = np.empty((len(unit), tables, probes), np.int64)
    for t in range(tables):
        # einsum and not a matrix product: a row's result must not depend on what rows are beside it
        y = np.einsum("nd,kd->nk", unit, matrices[t]) * scale + shifts[t]
        p = decode_e8(y)
        salt = (labels.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) ^ np.uint64(t + 1)
        home[:, t] = _cell_keys(p, salt)
        if probes:
            near = np.einsum("nk,vk->nv", y - p, _roots())
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            probed[:, t] = _cell_keys(p[:, None, :] + _roots()[best], np.repeat(salt[:, None], probes, 1))
    return home, probed


def _keys_of_all(unit: np.ndarray, labels: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``lattice_cells`` for many rows, a few at a time: distances to all facets of many rows would be large."""
    parts = [lattice_cells(unit[at : at + 4096], labels[at : at + 4096], tables, probes, scale, seed) for at in range(0, len(unit), 4096)]
    home, probed = zip(*parts, strict=True)
    return np.concatenate(home), np.concatenate(probed)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dimension(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    lengths = batch.column(batch.schema.names.index(name)).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        yield dim, batch.filter(pa.array(lengths == dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _cells(batches: Iterator[pa.RecordBatch], tables: int, probes: int, scale: float, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for dim, part in _by_dimension(batch.slice(at, 1024), "v"):
                labels = part.column("label").to_numpy(zero_copy_only=False)
                home, probed = lattice_cells(_unit(_matrix(part.column("v"), dim)), labels, tables, probes, scale, seed)
                keys = np.concatenate([home[:, :, None], probed], 2).reshape(len(labels), -1)
                width = keys.shape[1]
                lives = np.tile(np.arange(width) % (probes + 1) == 0, len(labels))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(len(labels)), width))),
                        part.column("d1").take(pa.array(np.repeat(np.arange(len(labels)), width))),
                        pa.array(keys.ravel()),
                        pa.array(lives),
                    ],
                    names=["vec_id", "d1", "cell", "home"],
                )


def _first_meeting(i: np.ndarray, j: np.ndarray, home: np.ndarray, probed: np.ndarray) -> np.ndarray:
    """The key of the first cell where rows i and j meet: in the first table, the smaller key."""
    hi, hj = home[i], home[j]
    same = hi == hj
    at_j = same | (probed[i] == hj[:, :, None]).any(2)
    at_i = same | (probed[j] == hi[:, :, None]).any(2)
    big = np.iinfo(np.int64).max
    cell = np.minimum(np.where(at_j, hj, big), np.where(at_i, hi, big))
    table = (at_i | at_j).argmax(1)
    return cell[np.arange(len(i)), table]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the components of linked rows; label has the smallest row of each row's component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def _compare(rows: dict[str, np.ndarray], cosine: float, tables: int, probes: int, scale: float, seed: int) -> list[tuple]:
    """Counts of links, and the smallest ids reachable, of the vectors of one cell or of two of its blocks."""
    x = rows["unit"]
    left = np.flatnonzero(rows["block"] == rows["p"])
    right = np.flatnonzero(rows["block"] == rows["q"])
    count = np.zeros(len(x), np.int64)
    label = np.arange(len(x))
    keys = None
    one = rows["p"] == rows["q"]
    for at in range(0, left.size, 128):
        own = left[at : at + 128]
        near = x[own] @ x[right].T >= cosine - 1e-9
        near &= rows["home"][own][:, None] | rows["home"][right][None, :]
        if one:
            near &= np.arange(at, at + own.size)[:, None] < np.arange(right.size)[None, :]
        a, b = np.nonzero(near)
        if not a.size:
            continue
        i, j = own[a], right[b]
        for k in range(0, i.size, 200_000):
            ii, jj = i[k : k + 200_000], j[k : k + 200_000]
            exact = np.einsum("nd,nd->n", x[ii], x[jj]) >= cosine
            ii, jj = ii[exact], jj[exact]
            _joined(label, ii, jj)
            if keys is None:
                keys = _keys_of_all(x, rows["label"], tables, probes, scale, seed)
            here = _first_meeting(ii, jj, *keys) == rows["cell"]
            ii, jj = ii[here], jj[here]
            np.add.at(count, ii, rows["weight"][jj])
            np.add.at(count, jj, rows["weight"][ii])
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, label, rows["vec_id"])
    least = least[label]
    hit = np.flatnonzero((count > 0) | (least < rows["vec_id"]))
    return [(rows["vec_id"][hit], rows["d1"][hit], count[hit], least[hit])]


def _compare_small(rows: dict[str, np.ndarray], run: np.ndarray, cosine: float, tables: int, probes: int, scale: float, seed: int) -> tuple:
    """As ``_compare`` for many cells of one block at once; ``run`` numbers the cell of each row, in order."""
    x, home, n = rows["unit"], rows["home"], len(run)
    count = np.zeros(n, np.int64)
    label = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, n):
        i = np.flatnonzero(run[step:] == run[:-step])
        if not i.size:
            break
        i = i[home[i] | home[i + step]]
        for at in range(0, i.size, 50_000):
            part = i[at : at + 50_000]
            part = part[np.einsum("nd,nd->n", x[part], x[part + step]) >= cosine]
            found.append((part, part + step))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    if i.size:
        _joined(label, i, j)
        some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = _keys_of_all(x[some], rows["label"][some], tables, probes, scale, seed)
        for at in range(0, i.size, 200_000):
            own = slice(at, at + 200_000)
            here = _first_meeting(place[: i.size][own], place[i.size :][own], *keys) == rows["cell"][i[own]]
            a, b = i[own][here], j[own][here]
            np.add.at(count, a, rows["weight"][b])
            np.add.at(count, b, rows["weight"][a])
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, rows["vec_id"])
    least = least[label]
    hit = np.flatnonzero((count > 0) | (least < rows["vec_id"]))
    return rows["vec_id"][hit], rows["d1"][hit], count[hit], least[hit]


def _cells_compared(batches: Iterator[pa.RecordBatch], cosine: float, tables: int, probes: int, scale: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (cell, p, q). Small cells are compared together, a larger one or two of its blocks alone."""
    names = ("vec_id", "d1", "home", "block", "weight", "label", "cell", "p", "q")
    law = (cosine, tables, probes, scale, seed)
    for table in whole_runs(batches, ("cell", "p", "q"), ROWS_AT_ONCE):
        for dim, t in _by_dimension(table, "v"):
            rows = {c: t.column(c).to_numpy(zero_copy_only=False) for c in names}
            starts = np.concatenate([[True], np.any([rows[c][1:] != rows[c][:-1] for c in ("cell", "p", "q")], axis=0)])
            run = np.cumsum(starts) - 1
            sizes = np.bincount(run)
            unit = _unit(_matrix(t.column("v"), dim))
            small = np.flatnonzero((sizes[run] > 1) & (sizes[run] <= SMALL) & (rows["p"] == rows["q"]))
            outs = []
            if small.size:
                outs.append(_compare_small({c: rows[c][small] for c in names} | {"unit": unit[small]}, run[small], *law))
            ends = np.append(np.flatnonzero(starts), len(run))
            for k in np.flatnonzero((sizes > SMALL) | ((sizes > 1) & (rows["p"] != rows["q"])[ends[:-1]])).tolist():
                own = slice(ends[k], ends[k + 1])
                one = {c: rows[c][own] for c in names} | {c: int(rows[c][ends[k]]) for c in ("cell", "p", "q")}
                outs += _compare(one | {"unit": unit[own]}, *law)
            for out in outs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["vec_id", "d1", "n", "least"])


def lattice_near_duplicates(
    embeddings: DataFrame,
    cosine: float = 0.98,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    block: int = BLOCK,
    seed: int = 8,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings`` (vec_id, embedding, label).

    Vectors are linked when their labels are equal and their cosine is at least ``cosine``. n_links counts
    the other rows linked directly; component_id is the smallest vec_id reachable by links; kept is
    true for that row.

    Defined cases: null labels, and vectors that are null, empty, zero or have a null, NaN or infinite component,
    link with nothing; vectors of different lengths never link; equal vectors of a label are linked,
    repeated rows too; rows that share a vec_id are compared each by itself and are one node of
    the components; a null vec_id links with nothing; an empty table gives no rows; other columns are not read.
    """
    # vectors of floats travel as floats, at half the bytes; every computation on them is in doubles
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    digests = [F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(k), "label", "v")).alias(f"d{k}") for k in (1, 2)]
    marked = rows.select("*", *digests)
    classes = materialize(marked.where("d1 is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")))
    # the classes, dealt evenly: a class is one row, whatever the number of its copies
    cells = materialize(classes.select("vec_id", "d1", "label", "v").mapInArrow(lambda it: _cells(it, tables, probes, scale, seed), "vec_id long, d1 long, cell long, home boolean"))
    met = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    blocks = met.select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = cells.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "d1"), F.col("blocks")).cast("int"))
    dealt = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("vec_id", "d1", "cell", "home", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    sent = dealt.join(classes.select("vec_id", "d1", "weight", "label", "v"), ["vec_id", "d1"])
    n = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.select("cell", "p", "q", "block", "vec_id", "d1", "home", "weight", "label", "v").repartition(n, "cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    found = materialize(sent.mapInArrow(lambda it: _cells_compared(it, cosine, tables, probes, scale, seed), "vec_id long, d1 long, n long, least long"))
    counts = found.groupBy("vec_id", "d1").agg(F.sum("n").alias("n"))
    # rows of a class are linked to its smallest id
    links = found.select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    copies = marked.where("d1 is not null").select(F.col("vec_id").alias("own"), "d1", "d2")
    heads = classes.select("vec_id", "d1", "d2", "weight").join(counts, ["vec_id", "d1"], "left").select("d1", "d2", F.col("vec_id").alias("head"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    shared = copies.join(heads.where("n > 0").select("d1", "d2", "head"), ["d1", "d2"]).where("own <> head").select(F.col("own").alias("a"), F.col("head").alias("b"))
    found_in = connected_components(links.union(shared))
    joined = marked.select("vec_id", "d1", "d2").join(heads, ["d1", "d2"], "left").join(found_in, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
