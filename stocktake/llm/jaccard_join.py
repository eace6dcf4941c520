"""N-gram Jaccard join by count vectors in packed R-trees, with exact results.

A document is the set of its distinct 5-word shingles. Shingles are hashed into
groups, about one for GROUP_SIZE shingles, and a set becomes the point of its
group counts. The sum of the coordinate minima of two points bounds the overlap
of their sets from above, and the same sum over the upper corners of two boxes
bounds it for all points in them. Points of unlike resolution are compared at
the coarser one, as groups halve by adding. Surviving pairs are verified on the
sets.

A tree over all points can't be held by one task, and its upper boxes can't tell
unrelated texts of one length apart. So points meet in cells: a cell holds the
documents that have one shingle among the first of their set, in an order that
puts shingles known to be common last. Sets that are similar enough share such a
shingle whatever the order, so cells lose no pair. Every candidate comes from
the trees, which are built over cells; a cell of up to LEAF points is a leaf.

Equal sets are one node. The trees are searched three times, so that groups of
copies are joined by few pairs and no pairs are listed within a group that is
connected already: first for the nearest smaller point of each point, in a few
cells of each node; then, in cells that hold several components, for the nearest
points of each two components; last for all pairs that are in different
components still. Cells beyond BLOCK points are dealt to blocks by size band and
component; blocks of one component don't meet, and a task sees two blocks at a
time.

Sets and nodes are told apart by 64-bit hashes.

Defined results: null texts and texts without words have no shingles and are
linked with nothing; a text of fewer than five words has its whole sequence as
one shingle; very long texts are read whole, and their points have at most
2**MAX_LEVEL groups; equal texts are linked; rows with a null id take part, but
component_id is the least id that is not null (null if there is none); rows that
share an id keep their own texts. An empty table gives no rows. Only the named
columns are read, so that further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktake.llm.common import bit_filter, free_name, in_arrow, in_filter, materialise, met_and_rest, row_key, row_mark, table
from stocktake.llm.components import connected_components

SHINGLE = 5
#: Two sets link when PERCENT of their union is shared.
PERCENT = 80
#: Shingles of a group, about; groups are two to a power between these.
GROUP_SIZE, MIN_LEVEL, MAX_LEVEL = 1, 4, 14
#: Common shingles: seen in this many sets of one task, and of all tasks; the table of them is broadcast and bounded.
COMMON_IN_TASK, COMMON_IN_ALL, COMMON_ENTRIES = 2, 6, 500_000
#: A shingle of two to this power sets is hot: its cell is made row by row, and never gathered.
HOT_LEVEL, SALTS = 10, 64
#: Members of a block of a cell, and of a leaf of its tree.
BLOCK, LEAF = 1024, 16
#: Partners of one set that a task verifies together.
PARTNERS = 256
#: Largest and smallest cells of a node that the first search looks into.
FIRST_CELLS = 2
MEMO_WORDS, SEEN_SETS, CHUNK, HELD_BYTES, HELD_PAIRS = 200_000, 100_000, 1_000_000, 4_000_000, 200_000
NEAREST, BETWEEN, ALL = "nearest", "between", "all"
ANCHOR = 9
_P = np.uint64(0x9E3779B97F4A7C15)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _memo() -> _Memo:
    return _Memo()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    mixed = hashes[: len(words) - width + 1].copy()
    for k in range(1, width):
        mixed = mixed * _P + hashes[k : len(words) - width + 1 + k]
    return np.unique(_mixed(mixed + np.uint64(width)))


def node_of(members: np.ndarray) -> int:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).view(np.int64).item()


def level_of(n):
    """Groups of a set of n shingles, as a power of two."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / GROUP_SIZE)), MIN_LEVEL, MAX_LEVEL).astype(np.int64)


def point_of(members: np.ndarray) -> bytes:
    """Group counts of a set, in as many bytes a group as the largest needs."""
    groups = 1 << int(level_of(len(members)))
    counts = np.bincount((members & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    top = counts.max(initial=0)
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def needed(a, b):
    """The least overlap with which sets of these sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_lengths(n: int) -> tuple[int, int]:
    """First shingles in order by which a set of n meets larger ones, and smaller ones."""
    return n - (-(-2 * PERCENT * n // (100 + PERCENT))) + 1, n - (-(-PERCENT * n // 100)) + 1


class Points:
    """Points by level, for sums of coordinate minima at the coarser level of two."""

    def __init__(self, cells: list[bytes], n: np.ndarray):
        self.n, self.level = n, level_of(n)
        self.place = np.zeros(len(n), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for level in np.unique(self.level).tolist():
            at = np.nonzero(self.level == level)[0]
            self.place[at] = np.arange(len(at))
            found = [cells[k] for k in at.tolist()]
            width = max(map(len, found)) >> level
            if all(len(c) >> level == 1 for c in found):
                self.rows[level] = np.frombuffer(b"".join(found), np.uint8).reshape(len(at), -1)
            else:
                kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
                self.rows[level] = np.array([np.frombuffer(c, kinds[len(c) >> level]) for c in found], kinds[width])

    def at_level(self, at: np.ndarray, level: int) -> np.ndarray:
        """The points ``at`` with 2**level groups, in as few bytes as they need; none may have fewer groups."""
        levels = np.unique(self.level[at]).tolist()
        if levels == [level]:
            return self.rows[level][self.place[at]]
        out = np.empty((len(at), 1 << level), np.uint32)
        for own in levels:
            some = self.level[at] == own
            x = self.rows[own][self.place[at[some]]]
            out[some] = x.reshape(len(x), -1, 1 << level).sum(axis=1, dtype=np.uint32)
        top = out.max(initial=0)
        return out.astype(np.uint8) if top < 1 << 8 else out.astype(np.uint16) if top < 1 << 16 else out

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of the coordinate minima of the points ``a`` and ``b``, row by row."""
        out = np.empty(len(a), np.int64)
        both = np.minimum(self.level[a], self.level[b])
        for level in np.unique(both).tolist():
            at = np.nonzero(both == level)[0]
            for part in np.array_split(at, (len(at) << level) // CHUNK + 1):
                out[part] = np.minimum(self.at_level(a[part], level), self.at_level(b[part], level)).sum(axis=1, dtype=np.uint32)
        return out


def tree_pairs(x: np.ndarray, sizes: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points whose summed coordinate minima reach the needed overlap, the smaller or former first.

    ``x`` is packed into leaves of LEAF points in order of size, and leaves into
    nodes of LEAF, up to a root; pairs of boxes are followed down while the bound
    over their upper corners holds. ``allowed(i, j)`` says which pairs matter.
    """
    order = np.argsort(sizes, kind="stable")
    x, n = x[order], sizes[order]
    levels = [(x, n)]  # upper corners, least sizes
    while len(levels[-1][0]) > 1:
        top, low = levels[-1]
        starts = np.arange(0, len(top), LEAF)
        levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts)))
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            continue
        top, low = levels[level - 1]
        ra, rb = np.arange(a * LEAF, min((a + 1) * LEAF, len(top))), np.arange(b * LEAF, min((b + 1) * LEAF, len(top)))
        bound = np.minimum(top[ra][:, None, :], top[rb][None, :, :]).sum(axis=2, dtype=np.uint32)
        good = bound >= needed(low[ra][:, None], low[rb][None, :])
        if level > 1:
            stack += [(level - 1, ra[i], rb[j]) for i, j in zip(*np.nonzero(good), strict=True) if ra[i] <= rb[j]]
        else:
            good &= ra[:, None] < rb[None, :]
            if good.any():
                i, j = np.nonzero(good)
                i, j = order[ra[i]], order[rb[j]]
                fine = allowed(i, j)
                us.append(i[fine])
                vs.append(j[fine])
    return np.concatenate(us), np.concatenate(vs)


def leaf_pairs(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal ``cell``; rows come sorted by cell, and cells have LEAF rows at most."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, LEAF):
        at = np.nonzero(cell[:-step] == cell[step:])[0]
        if not len(at):
            break
        us.append(at)
        vs.append(at + step)
    return np.concatenate(us), np.concatenate(vs)


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_LONG, _BINARY = pa.int64(), pa.binary()


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes | None]:
    """The texts of a batch, one at a time."""
    return (x.as_py() for x in batch.column(at).cast(pa.large_binary() if pa.types.is_large_string(batch.column(at).type) else _BINARY))


def set_rows(docs: DataFrame) -> DataFrame:
    """(id, key, n, node, point, common, sets): a row per document, and the common shingles of each task."""
    names = ["id", "key", "n", "node", "point", "common", "sets"]
    kinds = [_LONG, _LONG, _LONG, _LONG, _BINARY, _LONG, _LONG]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def common() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            many = counts >= COMMON_IN_TASK
            none = pa.nulls(int(many.sum()))
            return _batch(names, kinds, [*[none.cast(k) for k in kinds[:5]], pa.array(keys[many].view(np.int64)), pa.array(counts[many])])

        size = 0
        for batch in batches:
            rows = []
            for text in _texts(batch, 2):
                members = shingle_set(text)
                node = node_of(members)
                rows.append((len(members), node, point_of(members)))
                if node not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(node)
                    held.append(members)
                    size += len(members)
                    if size >= CHUNK:
                        yield common()
                        size = 0
            none = pa.nulls(batch.num_rows, _LONG)
            yield _batch(names, kinds, [batch.column(0), batch.column(1), *[list(c) for c in zip(*rows, strict=True)], none, none] if rows else [[] for _ in kinds])
        yield common()

    return in_arrow(docs, run, "id bigint, key bigint, n bigint, node bigint, point binary, common bigint, sets bigint")


def postings(docs: DataFrame, common: pa.Table) -> DataFrame:
    """(shingle, node, n, lead, hot): the first shingles of each set, once per task for equal sets."""
    keys = common.column("common").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], np.log2(common.column("sets").to_numpy()).astype(np.int8)[order] + np.int8(1)))
    names = ["shingle", "node", "n", "lead", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = shared.value
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple] = []
            for text in _texts(batch, 0):
                members = shingle_set(text)
                n = len(members)
                node = node_of(members)
                if not n or node in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(node)
                lead, whole = prefix_lengths(n)
                rank = np.zeros(n, np.int8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, members), len(known) - 1)
                    rank = np.where(known[at] == members, level[at], np.int8(0))
                    first = np.argsort(rank, kind="stable")[:whole]
                    members, rank = members[first], rank[first]
                parts.append((members[:whole].view(np.int64), np.full(whole, node), np.full(whole, n), np.arange(whole) < lead, rank[:whole] > HOT_LEVEL))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    return in_arrow(docs, run, "shingle bigint, node bigint, n bigint, lead boolean, hot boolean")


def shared_postings(rows: DataFrame) -> DataFrame:
    """(cell, node, n, lead): the postings of shingles that two nodes or more share.

    Copies share many shingles, so cells of up to LEAF members are told apart by
    their members and kept once. Larger ones go on row by row, so that no task
    holds more than a leaf of them; hot ones too, which are salted.
    """
    names = ["a", "b", "nodes", "ns", "leads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        big: int | None = None  # a shingle that has grown beyond a leaf
        last: int | None = None  # and its last node

        def cells(cols: list[np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, big, last
            key, node = cols[0], cols[1]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            if big is not None and len(key) and key[0] == big:
                fresh[0] &= node[0] != last
            key, node, n, lead, hot = (c[fresh] for c in cols)
            if not len(key):
                held = None
                return
            starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            lengths = np.diff(np.append(starts, len(key)))
            flat = (lengths > LEAF) | hot[starts] | (key[starts] == big if big is not None else False)
            whole = np.ones(len(starts), bool)
            if not final:
                if flat[-1]:
                    big, last, held = int(key[-1]), int(node[-1]), None
                else:
                    whole[-1] = False
                    held, big = [c[starts[-1] :] for c in (key, node, n, lead, hot)], None
            few = whole & ~flat & (lengths > 1)
            row = np.repeat(few, lengths)
            if row.any():
                marks = _mixed((node[row].view(np.uint64) << np.uint64(1)) | lead[row].astype(np.uint64))
                offsets = np.concatenate([[0], np.cumsum(lengths[few])])
                first, second = np.add.reduceat(marks, offsets[:-1]), np.bitwise_xor.reduceat(_mixed(marks), offsets[:-1])
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c[row])) for c in (node, n, lead)]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), *lists], names=names)
            row = np.repeat(flat, lengths)
            if row.any():  # a row each, told apart by shingle and node
                offsets = pa.array(np.arange(row.sum() + 1), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c[row])) for c in (node, n, lead)]
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(node[row]), *lists], names=names)

        for batch in batches:
            if batch.num_rows:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                yield from cells([np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols, False)
        if held:
            yield from cells(held, True)

    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0)
    rows = rows.repartition("shingle", salt).sortWithinPartitions("shingle", "node").select("shingle", "node", "n", "lead", "hot")
    made = in_arrow(rows, run, "a bigint, b bigint, nodes array<bigint>, ns array<bigint>, leads array<boolean>")
    once = made.groupBy("a", "b").agg(F.first("nodes").alias("nodes"), F.first("ns").alias("ns"), F.first("leads").alias("leads"))
    return once.select("a", F.explode(F.arrays_zip("nodes", "ns", "leads")).alias("m")).select(F.col("a").alias("cell"), F.col("m.nodes").alias("node"), F.col("m.ns").alias("n"), F.col("m.leads").alias("lead"))


def tiled(rows: DataFrame, nodes: DataFrame, what: str) -> DataFrame:
    """(tile, side, node, component, n, lead, point): what each task of a search compares.

    ``rows``: cell, node, component, n, lead, members. A cell of up to BLOCK
    members is a tile, with side 0. Larger ones are dealt to blocks by size band
    and, where a component fills blocks, by component; each two blocks of one
    band or of neighbours are a tile, with sides 1 and 2, unless they are of one
    component. For NEAREST, blocks are tiles of their own, each with the least
    node of the band at side ANCHOR.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int")
    small = rows.where(F.col("members") <= BLOCK).select(F.xxhash64("cell").alias("tile"), F.lit(0).alias("side"), "node", "component", "n", "lead")
    large = rows.where(F.col("members") > BLOCK).withColumn("band", band)
    counts = large.groupBy("cell", "band", "component").agg(F.count("*").alias("c")).withColumn("whole", F.when(F.col("c") > BLOCK, F.col("component")))
    parts = counts.groupBy("cell", "band", "whole").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks")).withColumn("part", F.xxhash64("cell", "band", F.col("whole").isNull(), "whole"))
    listed = parts.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = materialise(listed.select("cell", "band", "whole", F.xxhash64("part", "number").alias("block")), "blocks")
    a = listed.select("cell", F.col("band").alias("band_a"), F.col("whole").alias("whole_a"), F.col("block").alias("a"))
    b = listed.select("cell", F.col("band").alias("band_b"), F.col("whole").alias("whole_b"), F.col("block").alias("b"))
    meet = a.join(b, "cell").where("((band_a = band_b and a <= b) or band_a + 1 = band_b) and coalesce(whole_a <> whole_b, true)")
    meet = meet.where("a = b" if what == NEAREST else "true").select("cell", "band_a", "a", "b", F.xxhash64("a", "b").alias("tile"))
    sides = meet.where("a <> b").select("tile", F.col("a").alias("block"), F.lit(1).alias("side")).unionByName(meet.where("a <> b").select("tile", F.col("b").alias("block"), F.lit(2).alias("side")))
    sides = sides.unionByName(meet.where("a = b").select("tile", F.col("a").alias("block"), F.lit(0).alias("side")))
    wholes = counts.where("whole is not null").select("cell", "band", "component", "whole")
    dealt = large.join(wholes, ["cell", "band", "component"], "left").withColumn("part", F.xxhash64("cell", "band", F.col("whole").isNull(), "whole")).join(parts.select("part", "blocks"), "part")
    dealt = dealt.withColumn("block", F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    dealt = dealt.join(sides, "block").select("tile", "side", "node", "component", "n", "lead")
    if what == NEAREST:
        least = large.groupBy("cell", F.col("band").alias("band_a")).agg(F.min(F.struct("node", "component", "n", "lead")).alias("least"))
        dealt = dealt.unionByName(meet.join(least, ["cell", "band_a"]).select("tile", F.lit(ANCHOR).alias("side"), "least.*"))
    return small.unionByName(dealt).join(nodes.select("node", "point"), "node")


def searched(rows: DataFrame, nodes: DataFrame, what: str) -> DataFrame:
    """Distinct pairs (u, v) of nodes of one cell and different components that can link, found in the trees.

    NEAREST gives each point its nearest smaller one in a tile, and the anchor of
    the tile its nearest one, BETWEEN the nearest points of each two components
    in a tile, ALL all pairs.
    """

    def pairs_of(part: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, side, node, comp, size, lead = (part.column(c).to_numpy() for c in ("tile", "side", "node", "component", "n", "lead"))
        points = Points(part.column("point").to_pylist(), size)

        def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            led = np.where(size[a] < size[b], lead[a], np.where(size[a] > size[b], lead[b], lead[a] | lead[b]))
            near = 100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b])
            return led & near & (comp[a] != comp[b]) & ((side[a] == 0) | (side[a] != side[b]))

        def best(u: np.ndarray, v: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((node[u], -points.overlap(u, v), *keys))
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
            return u[order[fresh]], v[order[fresh]]

        def chosen(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            if what == NEAREST and len(u):
                held = (side[u] == ANCHOR) | (side[v] == ANCHOR)
                u, v = (np.concatenate(x) for x in zip(best(u, v, v), best(u[held], v[held], tile[u[held]]), strict=True))
            elif what == BETWEEN and len(u):
                u, v = best(u, v, np.maximum(comp[u], comp[v]), np.minimum(comp[u], comp[v]), tile[u])
            return _batch(["u", "v"], [_LONG, _LONG], [pa.array(np.minimum(node[u], node[v])), pa.array(np.maximum(node[u], node[v]))])

        starts = np.nonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))[0]
        lengths = np.diff(np.append(starts, len(tile)))
        at = np.nonzero(np.repeat(lengths <= LEAF, lengths))[0]
        u, v = leaf_pairs(tile[at])
        u, v = at[u], at[v]
        fine = allowed(u, v)
        u, v = u[fine], v[fine]
        fine = points.overlap(u, v) >= needed(size[u], size[v])
        u, v = u[fine], v[fine]
        later = (size[u] > size[v]) | ((size[u] == size[v]) & (node[u] > node[v]))
        yield chosen(np.where(later, v, u), np.where(later, u, v))
        for start, length in zip(starts[lengths > LEAF].tolist(), lengths[lengths > LEAF].tolist(), strict=True):
            rows = start + np.lexsort((node[start : start + length], size[start : start + length]))
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            first = 0
            while first < length:  # the sizes of a band, with all that they can link with
                low = size[rows[first]]
                own = int(np.searchsorted(size[rows], low * 100 // PERCENT, "right"))
                reach = int(np.searchsorted(size[rows], size[rows[own - 1]] * 100 // PERCENT, "right"))
                some = rows[first:reach]
                a, b = tree_pairs(points.at_level(some, int(points.level[some[0]])), size[some], lambda i, j, some=some, width=own - first: (i < width) & allowed(some[i], some[j]))
                us.append(some[a])
                vs.append(some[b])
                first = own
            u, v = np.concatenate(us), np.concatenate(vs)
            yield chosen(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[pa.RecordBatch] = []
        count = 0

        def out() -> pa.RecordBatch:
            found = pa.Table.from_batches(pairs).group_by(["u", "v"]).aggregate([]).combine_chunks().to_batches()
            pairs.clear()
            return found[0] if found else _batch(["u", "v"], [_LONG, _LONG], [[], []])

        def found(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal count
            for made in pairs_of(part):
                pairs.append(made)
                count += made.num_rows
                if count > HELD_PAIRS:
                    yield out()
                    count = 0

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:  # all whole tiles; the last goes on
                made = pa.Table.from_batches(held).combine_chunks()
                tile = made.column("tile").to_numpy()
                cut = int(np.searchsorted(tile, tile[-1]))
                if cut:
                    yield from found(made.slice(0, cut))
                held = made.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())
        if pairs:
            yield out()

    return in_arrow(tiled(rows, nodes, what).repartition("tile").sortWithinPartitions("tile"), run, "u bigint, v bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets link. ``docs``: key, text; ``nodes``: node, key (of one of its rows).

    Only texts of nodes in a pair are needed. A bit filter of bounded size over
    their keys picks them while the texts are read; what it lets through by
    chance finds no partner in the join. A pair's second text travels to its
    first, which is sent once to each PARTNERS of its partners.
    """
    spark = docs.sparkSession
    buckets = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("buckets"))
    dealt = pairs.join(buckets, "u").select(F.col("u").alias("head"), F.pmod(F.xxhash64("v"), "buckets").alias("bucket"), F.col("v").alias("node"), F.lit(1).alias("part"))
    roles = dealt.unionByName(dealt.select("head", "bucket", F.col("head").alias("node"), F.lit(0).alias("part")).distinct())
    roles = materialise(roles.join(nodes.select("node", "key"), "node"), "roles")
    shared = spark.sparkContext.broadcast(bit_filter(roles.select("key").distinct(), "key"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column(0).to_numpy())))

    found = in_arrow(docs.select("key", "text"), picked, "key bigint, text string").join(roles.hint("merge"), "key").select("head", "bucket", "part", "node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for h, part, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _texts(batch, 4), strict=True):
                if part == 1:
                    other = shingle_set(text)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    good.append(100 * both >= PERCENT * (len(own) + len(other) - both))
                else:
                    if h != head:
                        head, own = h, shingle_set(text)
                    good.append(False)
            yield _batch(["u", "v"], [_LONG, _LONG], [batch.column(0), batch.column(3)]).filter(pa.array(good, pa.bool_()))

    dealt = found.repartition("head", "bucket").sortWithinPartitions("head", "bucket", "part")
    return materialise(in_arrow(dealt, check, "u bigint, v bigint").distinct(), "links")


def mixed_cells(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of cells that hold several components, with their component."""
    placed = cells.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("cell").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("lead").alias("led")).where("a <> b and led").select("cell")
    return materialise(placed.join(mixed, "cell", "left_semi"), "mixed")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, component, key (of id and text)."""
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), row_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    made = materialise(set_rows(read), "sets")
    rows = made.where("node is not null").select("id", "key", "n", "node")
    common = made.where("common is not null").groupBy("common").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= COMMON_IN_ALL).orderBy(F.desc("sets"), "common").limit(COMMON_ENTRIES).toArrow()

    cells = materialise(shared_postings(postings(read.select("text"), common)), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("members"))
    cells = materialise(cells.join(sizes.where("members > 1"), "cell"), "sized-cells")
    meeting = cells.select("node").distinct()
    nodes = made.where("n > 0").select("node", "key", "point").join(meeting, "node", "left_semi")
    nodes = materialise(nodes.groupBy("node").agg(F.min("key").alias("key"), F.min("point").alias("point")), "nodes")

    # Rows of equal members and size make the same choice in every task, so that the members of a group choose alike.
    order = [Window.partitionBy("node").orderBy(F.col("members").desc(), "cell"), Window.partitionBy("node").orderBy("members", "cell")]
    first = cells.withColumns({"large": F.row_number().over(order[0]), "least": F.row_number().over(order[1])}).where(f"large <= {FIRST_CELLS} or least = 1")
    first = first.select("cell", "node", F.col("node").alias("component"), "n", F.lit(True).alias("lead"), "members")
    tried = materialise(searched(first, nodes, NEAREST), "pairs")
    links = verified(tried, read, nodes)
    parts = connected_components(links.toDF("src", "dst"))
    for what in (BETWEEN, ALL):
        found = materialise(searched(mixed_cells(cells, parts), nodes, what), "pairs")
        if found.isEmpty():
            break  # nothing can link, tried or not
        more = materialise(found.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.unionByName(more)
        links = verified(more, read, nodes).toDF("src", "dst")
        parts = connected_components(parts.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(links))

    member = rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = materialise(member, "member")
    least = member.where("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    return member.join(least, "component", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), "component", "key")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of least id and key; documents without words all stay."""
    mark, stays = free_name(docs, "_mark"), free_name(docs, "_stays")
    found = jaccard_components(docs, id_col, text_col).where("n_shingles > 0").select("component", F.struct(F.col(id_col).alias("id"), "key").alias(mark))
    found = materialise(found, "components-of-rows")
    best = found.groupBy("component").agg(F.min(F.struct(F.col(mark)["id"].isNull().alias("unknown"), F.col(mark).alias("mark")))["mark"].alias("best"))
    judged = found.join(best, "component").groupBy(mark).agg(F.min(F.col(mark) == F.col("best")).alias(stays), F.count("*").alias("rows"))
    judged = materialise(judged.where(~F.col(stays) | (F.col("rows") > 1)).select(mark, stays), "judged")
    met, rest = met_and_rest(docs.withColumn(mark, row_mark(docs, id_col, text_col)), mark, judged)
    met = met.join(judged.hint("merge"), mark, "left")
    kept = rest.unionByName(met.where(F.col(stays).isNull()).drop(stays))
    if not judged.where(stays).isEmpty():  # repeated rows, of which one stays
        kept = kept.unionByName(met.where(stays).drop(stays).dropDuplicates([mark]))
    return kept.select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE
 w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * met >= 80 * (p.n + q.n - met)),
 d AS (SELECT x AS src, y AS dst FROM e UNION ALL SELECT y, x FROM e),
 r(a, b) AS (SELECT src, dst FROM d UNION SELECT r.a, d.dst FROM r JOIN d ON r.b = d.src),
 m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""
