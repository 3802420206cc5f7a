"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts hashes each document's distinct shingles and keeps what later steps
   need: the size and a 128-bit digest of the set, band keys from full-width minima, and the
   low b bits of all minima packed into longs.
2. Documents with equal sets (all copies) become one class with its smallest id, so a group of any number of
   copies is one row.
3. Classes that share a band key are candidates. A task takes whole buckets of packed signatures and estimates
   similarity from the bit count of equal fields, corrected for chance equality of b bits. It returns
   a few edges that connect what estimates far enough to be linked; these edges give groups of alike classes.
4. The texts of a group are sent to one task once, whatever the number of buckets its members met in. There the full sets
   decide, and verified links that connect the group come out.

No pair is ever a row. In a task all rows are compared with the first one (the hub) and only rows that it leaves
apart with the others, so a bucket of near copies costs as many comparisons as it has members. Buckets and groups
beyond a size are cut into blocks; see ``_connected``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftscan.llm.components import connected_components
from weftscan.llm.runs import whole_runs
from weftscan.llm.store import materialize

#: Bands and rows: at similarity 0.8 a pair shares no band with probability 3e-5, at 0.3 one with 1 %.
BANDS, ROWS, SIGNATURE_BITS = 44, 7, 2
#: A pair is given up when its estimate is this far below the threshold (about five standard errors).
MARGIN = 0.14

#: The bits kept of a minimum begin here: the lowest bits of a product hang on too few bits of the hash.
_LOW_AT = 20
_MEMO_WORDS = 500_000
#: Blocks: signatures of a bucket, and texts of a group (of up to 1,000 shingles; a longer text counts as several).
ROWS_AT_ONCE, BLOCK = 8192, 1024


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions, from a seed."""
    state = np.random.Generator(np.random.PCG64(seed))
    return state.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1), state.integers(0, 1 << 64, n, np.uint64, endpoint=False)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class ShingleHasher:
    """64-bit hashes of the k-word shingles of texts, word hashes remembered up to a bound."""

    def __init__(self, k: int):
        self.k, self._memo = k, {}

    def words(self, text: bytes) -> list[int]:
        memo, out = self._memo, []
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        words = text.lower().split()
        try:
            return [memo[w] for w in words]
        except KeyError:
            for w in words:
                h = memo.get(w)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(w)
                    if len(w) <= 64:
                        memo[w] = h
                out.append(h)
            return out

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text.

        Words are what stands between ASCII white space, with A-Z lower-cased. With fewer words than k
        the whole sequence is one shingle; without words the set is empty.
        """
        out = []
        for text in texts:
            h = np.array(self.words(text), np.uint64) if text else np.empty(0, np.uint64)
            if h.size:
                n = max(h.size - self.k + 1, 1)
                s = np.full(n, min(h.size, self.k), np.uint64)
                for j in range(min(self.k, h.size)):
                    s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
                h = np.sort(s)
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
            out.append(h)
        return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist())


def _signatures(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    n = bands * rows
    mul, add = _constants(n, seed)
    band_mul, band_add = _constants(rows, seed + 1)
    hasher = ShingleHasher(k)
    per_long = 64 // bits
    longs = -(-n // per_long)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            raw = [t.as_buffer().to_pybytes() if t.is_valid else None for t in part.column(1)]
            sets = hasher.sets(raw)
            sizes = np.fromiter((s.size for s in sets), np.int64, len(sets))
            filled = np.flatnonzero(sizes)
            minima = np.zeros((n, len(sets)), np.uint64)
            # long texts in pieces of their own, so the work space stays small
            group, total = [], 0
            for j in [*filled.tolist(), -1]:
                if group and (j < 0 or total + sizes[j] > 65_536):
                    values = np.concatenate([sets[g] for g in group])
                    starts = np.concatenate([[0], np.cumsum(sizes[group])[:-1]])
                    for f in range(n):
                        minima[f, group] = np.minimum.reduceat(_spread(values, mul[f], add[f]), starts)
                    group, total = [], 0
                if j >= 0:
                    group.append(j)
                    total += int(sizes[j])
            digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            keys = np.zeros((len(sets), bands), np.uint64)
            for b in range(bands):
                key = np.full(len(sets), b + 1, np.uint64)
                for r in range(rows):
                    key = _mixed(key * band_mul[r] + minima[b * rows + r] + band_add[r])
                keys[:, b] = key
            packed = np.zeros((len(sets), longs), np.uint64)
            low = (minima >> np.uint64(_LOW_AT)) & np.uint64((1 << bits) - 1)
            for f in range(n):
                packed[:, f // per_long] |= low[f] << np.uint64(bits * (f % per_long))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists(packed), _lists(keys)],
                names=["doc_id", "n_shingles", "d1", "d2", "packed", "bands"],
            )


def _spread(values: np.ndarray, mul: np.uint64, add: np.uint64) -> np.ndarray:
    """Another order of shingle hashes, which are well mixed themselves."""
    y = values * mul
    y += add
    return y


def _lists(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), flat)


def signatures(docs: DataFrame, shingle_words: int = 5, bands: int = BANDS, rows: int = ROWS, bits: int = SIGNATURE_BITS, seed: int = 1) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), packed (longs of b-bit minima) and bands (keys) of each text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(
        lambda it: _signatures(it, shingle_words, bands, rows, bits, seed),
        "doc_id long, n_shingles long, d1 long, d2 long, packed array<long>, bands array<long>",
    )


def _differing(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """How many packed fields differ in each row: any bit of a field decides."""
    low = np.uint64(sum(1 << k for k in range(0, 64, bits)))
    z = x ^ y
    folded = z.copy()
    for k in range(1, bits):
        folded |= z >> np.uint64(k)
    return np.bitwise_count(folded & low).sum(1, dtype=np.int64)


def corrected_similarity(x: np.ndarray, y: np.ndarray, fields: int, bits: int) -> np.ndarray:
    """Similarity from packed minima: the share of equal b-bit fields, corrected for chance equality.

    Unused fields of the last long are equal on both sides and are not among ``fields``.
    """
    chance = 2.0**-bits
    return (1 - _differing(x, y, bits) / fields - chance) / (1 - chance)


@dataclass(frozen=True)
class _Law:
    """What a pair has to reach, and how signatures are packed."""

    k: int
    percent: int
    fields: int
    bits: int
    margin: float

    def possible(self, packed: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs (i, j) whose sizes and estimates do not rule out a link."""
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        out = 100 * small >= self.percent * large
        at = np.flatnonzero(out)
        out[at] = corrected_similarity(packed[i[at]], packed[j[at]], self.fields, self.bits) >= self.percent / 100 - self.margin
        return out

    def reached(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (a + b - shared)


def _bounded_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Tables of whole (group, part) runs, and where the runs begin and the last ends."""
    for table in whole_runs(batches, ("group", "part"), rows):
        group, part = (table.column(c).to_numpy() for c in ("group", "part"))
        starts = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1])) + 1
        yield table, np.concatenate([[0], starts, [table.num_rows]])


def _packed_matrix(table: pa.RecordBatch) -> np.ndarray:
    return table.column("packed").flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
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


def _first_of(names: np.ndarray) -> np.ndarray:
    """For each row of ``names`` the first row equal to it."""
    _, first, inverse = np.unique(names, axis=0, return_index=True, return_inverse=True)
    return first[inverse.ravel()]


def _product(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two lists of rows, in pieces of about ``most``."""
    step = max(1, most // max(right.size, 1))
    for at in range(0, left.size, step):
        own = left[at : at + step]
        yield np.repeat(own, right.size), np.tile(right, own.size)


def _met(batches: Iterator[pa.RecordBatch], law: _Law) -> Iterator[pa.RecordBatch]:
    """Links (a, b) enough to connect the rows of each run that estimates connect.

    All rows of a run are compared with its first one; only rows that this leaves apart are compared with the others.
    """
    for table, bounds in _bounded_runs(batches, 20_000):
        node, side, known, sizes = (table.column(c).to_numpy() for c in ("node", "side", "c", "n_shingles"))
        packed, n = _packed_matrix(table), table.num_rows
        run = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
        hub, two_sided = bounds[:-1][run], side[bounds[1:] - 1][run] == 1
        label = np.arange(n)
        both = np.flatnonzero(two_sided)
        label[both] = both[_first_of(np.stack([run[both], known[both]], 1))]
        use = np.flatnonzero(~two_sided & (hub != label))
        good = law.possible(packed, sizes, hub[use], use)
        _merge(label, hub[use][good], use[good])
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def test() -> None:
            nonlocal held
            i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            held = 0
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            good = law.possible(packed, sizes, i, j)
            _merge(label, i[good], j[good])

        for a, z in itertools.pairwise(bounds.tolist()):
            own = np.arange(a, z)
            if side[z - 1]:
                left, right = own[side[a:z] == 0], own[side[a:z] == 1]
            else:
                left, right = own[label[a:z] != label[a]], own
            for i, j in _product(left, right, 200_000):
                keep = label[i] != label[j]
                if not side[z - 1]:
                    # a pair of two rows that are left over comes up twice
                    keep &= (i < j) | (label[j] == label[a])
                waiting.append((i[keep], j[keep]))
                held += int(keep.sum())
                if held >= 200_000:
                    test()
        if waiting:
            test()
        hit = np.flatnonzero(label != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[label[hit]])], names=["a", "b"])


def shared_counts(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` (indices) shares with every set, exactly.

    A shingle that many sets hold is a column of a 0/1 matrix whose product counts it; one that few sets
    hold is counted pair by pair.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [s.size for s in sets])
    _, column, held_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    times = held_by[column]
    out = np.zeros((left.size, n), np.float32)
    place = np.full(n, -1)
    place[left] = np.arange(left.size)
    common = max(8, n // 16)
    some = (times > 1) & (times <= common)
    r, c = row[some], column[some]
    for step in range(1, int(times[some].max(initial=1))):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not same.size:
            break
        for x, y in ((r[same], r[same + step]), (r[same + step], r[same])):
            own = place[x] >= 0
            np.add.at(out, (place[x[own]], y[own]), 1)
    many = times > common
    r, c = row[many], column[many]
    names, c = np.unique(c, return_inverse=True)
    for at in range(0, names.size, 2048):
        a, z = np.searchsorted(c, [at, at + 2048])
        x = np.zeros((n, min(2048, names.size - at)), np.float32)
        x[r[a:z], c[a:z] - at] = 1
        out += x[left] @ x.T
    return out


def _links_of_run(sets: list[np.ndarray], packed: np.ndarray, side: np.ndarray, known: np.ndarray, law: _Law) -> list[tuple[int, int]]:
    """Verified links between rows of one run that join all that verified links join."""
    n = len(sets)
    sizes = np.fromiter((s.size for s in sets), np.int64, n)
    two_sided = bool(side.any())
    label = _first_of(known[:, None]) if two_sided else np.arange(n)
    links: list[tuple[int, int]] = []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if label[a] != label[b]:
                shared = np.intersect1d(sets[a], sets[b], assume_unique=True).size
                if law.reached(shared, sizes[a], sizes[b]):
                    links.append((a, b))
                    low, high = sorted((label[a], label[b]))
                    label[label == high] = low

    if not two_sided:
        rest = np.arange(1, n)
        first = np.zeros(n - 1, np.int64)
        good = law.possible(packed, sizes, first, rest)
        verify(first[good], rest[good])
    left = np.flatnonzero(side == 0) if two_sided else np.flatnonzero(label != label[0])
    right = np.flatnonzero(side == 1) if two_sided else np.arange(n)
    found, total = [], 0
    for i, j in _product(left, right, 200_000):
        keep = label[i] != label[j]
        if not two_sided:
            keep &= (i < j) | (label[j] == label[0])
        i, j = i[keep], j[keep]
        good = law.possible(packed, sizes, i, j)
        found.append((i[good].astype(np.int32), j[good].astype(np.int32)))
        total += int(good.sum())
    if not total:
        return links
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if total <= max(2000, 8 * n):
        verify(i, j)
        return links
    for at in range(0, left.size, 512):
        own = left[at : at + 512]
        mine = (i >= own[0]) & (i <= own[-1])
        a, b = i[mine], j[mine]
        if not (label[a] != label[b]).any():
            continue
        counts = shared_counts(sets, own)[np.searchsorted(own, a), b]
        good = law.reached(counts.astype(np.int64), sizes[a], sizes[b])
        for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
            if label[x] != label[y]:
                links.append((x, y))
                low, high = sorted((label[x], label[y]))
                label[label == high] = low
    return links


def _confirmed(batches: Iterator[pa.RecordBatch], law: _Law) -> Iterator[pa.RecordBatch]:
    """Links (a, b, rep_a, rep_b) between the classes of each run whose full sets reach the similarity.

    A row whose text is not the text of its class (another one under the same doc_id) is left out.
    """
    hasher = ShingleHasher(law.k)
    for table, bounds in _bounded_runs(batches, 2_000):
        node, second, rep, side, known = (table.column(c).to_numpy() for c in ("node", "d2", "rep", "side", "c"))
        packed = _packed_matrix(table)
        texts = table.column("text")
        out: list[tuple[int, int]] = []
        for a, z in itertools.pairwise(bounds.tolist()):
            if z - a < 2:
                continue
            sets = hasher.sets([t.as_buffer().to_pybytes() if t.is_valid else None for t in texts[a:z]])
            own, seen = [], set()
            for k, s in enumerate(sets):
                mark = (*_digest(s), side[a + k])
                if mark[:2] == (node[a + k], second[a + k]) and mark not in seen:
                    seen.add(mark)
                    own.append(k)
            if len(own) < 2:
                continue
            at = a + np.array(own)
            found = _links_of_run([sets[k] for k in own], packed[at], side[at], known[at], law)
            out += [(int(at[x]), int(at[y])) for x, y in found]
        i, j = np.array(out, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[i], node[j], rep[i], rep[j])], names=["a", "b", "rep_a", "rep_b"])


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (group, node, weight) with the group's hub (smallest node), its number of blocks and the row's block."""
    sizes = rows.groupBy("group").agg(F.sum("weight").alias("_w"), F.min("node").alias("hub"))
    sized = sizes.select("group", "hub", F.greatest(F.ceil(F.col("_w") / block), F.lit(1)).cast("int").alias("blocks"))
    return materialize(rows.join(sized, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))


def _connected(rows: DataFrame, block: int, compare) -> DataFrame:
    """Links that connect what ``compare`` connects within groups of ``rows`` (group, node, weight).

    ``compare`` takes (group, part, side, node, c) and gives links (a, b, ...) between rows of a part: all rows of a
    part of one side, or rows of side 0 with rows of side 1 whose c differ. A group of one block is
    one part. A larger one is compared block by block, its hub beside each block; then what is not connected to
    the hub yet is compared, in blocks, with every block. So a large group that its hub connects costs one row for
    each member, and no part holds more than two blocks.
    """
    placed = _dealt(rows, block)
    own = F.array(F.col("block"))
    parts = F.when((F.col("node") == F.col("hub")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    none = [F.lit(0).alias("side"), "node", F.col("node").alias("c")]
    links = materialize(compare(placed.select("group", F.explode(parts.cast("array<long>")).alias("part"), *none)))
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return links
    found = connected_components(links)
    marked = large.join(found, large["node"] == found["id"], "left").select("group", "node", "weight", "hub", "blocks", "block", F.coalesce("component_id", "node").alias("c"))
    centre = marked.where("node = hub").select("group", F.col("c").alias("_centre"))
    marked = materialize(marked.join(centre, "group").withColumn("rest", F.col("c") != F.col("_centre")))
    rests = marked.where("rest").groupBy("group").agg(F.greatest(F.ceil(F.sum("weight") / block), F.lit(1)).cast("int").alias("strips"))
    met = marked.join(rests, "group")
    strip = F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.col("strips"))
    left = met.where("rest").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_b")).select("group", (strip * F.col("blocks") + F.col("_b")).cast("long").alias("part"), F.lit(0).alias("side"), "node", "c")
    right = met.select("*", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("_s")).select("group", (F.col("_s") * F.col("blocks") + F.col("block")).cast("long").alias("part"), F.lit(1).alias("side"), "node", "c")
    return links.union(materialize(compare(left.union(right))))


def _tasks(rows: DataFrame) -> DataFrame:
    """``rows`` with each (group, part) in one task and in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "group", "part").sortWithinPartitions("group", "part", "side", "node")


def minhash_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = SIGNATURE_BITS, margin: float = MARGIN, block: int = BLOCK, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Two documents are linked when their sets of ``shingle_words``-word shingles (A-Z lower-cased, words
    between ASCII white space) share at least ``percent`` / 100 of their union. component_id is the smallest
    doc_id reachable by links; kept is true for that document.

    Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a
    text with fewer words than a shingle is one shingle; texts of any length are compared whole;
    equal sets are always linked; rows that share a doc_id each appear and are one node, each with the links of its own text;
    a null doc_id links with nothing, has a null component and is kept; an empty table gives no rows;
    other columns are not read.
    """
    sigs = materialize(signatures(docs, shingle_words, bands, rows, bits))
    filled = sigs.where("n_shingles > 0 and doc_id is not null")
    # Spark cuts each task's copies to one row before it shuffles them
    smallest = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("doc_id"))
    classes = filled.withColumn("_k", smallest).where("_k = 1")
    classes = materialize(classes.select(F.col("d1").alias("node"), "d2", F.col("doc_id").alias("rep"), "n_shingles", "packed", "bands"))
    links = _links(docs, classes, _Law(shingle_words, percent, bands * rows, bits, margin), block, rows_at_once)
    # rows that share a doc_id but not a text tie their classes together
    ties = filled.groupBy("doc_id").agg(*[f(d).alias(f"{f.__name__}_{d}") for f in (F.min, F.max) for d in ("d1", "d2")])
    ties = ties.where("min_d1 <> max_d1 or min_d2 <> max_d2").select("doc_id")
    heads = classes.select(F.col("node").alias("d1"), "d2", "rep")
    shared = filled.select("doc_id", "d1", "d2").join(ties, "doc_id", "left_semi").join(heads, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.union(shared))
    placed = heads.join(found, heads["rep"] == found["id"], "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    sound = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = sigs.select("doc_id", "n_shingles", *[F.when(sound, F.col(d)).alias(d) for d in ("d1", "d2")])
    joined = own.join(placed, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (component.eqNullSafe(F.col("doc_id"))).alias("kept"))


def _links(docs: DataFrame, classes: DataFrame, law: _Law, block: int, rows_at_once: int) -> DataFrame:
    """Verified links (a, b) between representatives, enough for the components of classes."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1")
    # buckets with the same members are one bucket
    distinct = buckets.groupBy("n", "low", "mark").agg(F.min("key").alias("key"))
    members = keyed.join(distinct.select("key"), "key").select(F.col("key").alias("group"), "node", F.lit(1).alias("weight"))
    packed = classes.select("node", "n_shingles", "packed")

    def met(dealt: DataFrame) -> DataFrame:
        return _tasks(dealt.join(packed, "node")).mapInArrow(lambda it: _met(it, law), "a long, b long")

    alike = connected_components(_connected(materialize(members), rows_at_once, met))
    # a row of a task is about a thousand shingles, or a whole text below that
    weight = F.ceil(F.col("n_shingles") / 1000)
    grouped = materialize(alike.join(classes, alike["id"] == classes["node"]).select(F.col("component_id").alias("group"), "node", weight.alias("weight"), "d2", "rep", "packed"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).where("text is not null")
    carried = grouped.select("node", "d2", "rep", "packed")

    def confirmed(dealt: DataFrame) -> DataFrame:
        sent = dealt.join(carried, "node").join(texts, "rep")
        return _tasks(sent).mapInArrow(lambda it: _confirmed(it, law), "a long, b long, rep_a long, rep_b long")

    return _connected(grouped.select("group", "node", "weight"), block, confirmed).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
