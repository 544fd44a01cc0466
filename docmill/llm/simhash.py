"""SimHash near-duplicates with vantage-point trees.

Fingerprints are 64 bits; two link if they differ in at most ``radius`` bits.
Equal fingerprints are one node.  The tree works with *masked* distances: level
k looks only at the bits of mask k, takes the distance to a vantage point over
those bits, and gives each distance a branch.  A masked distance is at most the
full one, and since the masks share no bit their distances add up; so two
fingerprints within the radius differ in their distances to the vantage points
by at most the radius *in sum over all levels*.  That triangle bound prunes.

* The trunk, the first levels of the tree, deals the nodes over shards by their
  distances to the trunk's vantage points, and goes deeper where a cell has
  more than ``SHARD_NODES`` nodes.  When all bits are used up it begins again
  with the bits in another order and a fresh budget.
* A node is stored in one shard.  As a query it goes to that shard and to each
  other shard whose boundary its radius overlaps, with what is left of the
  radius (each two shards are matched in one direction only).  Where a shard is
  asked more than ``ASKED_ROWS`` nodes, these are dealt over several slices.
* In a shard, the tree goes on over the remaining masks, with vantage points
  from the shard's own nodes, down to small leaves, where the surviving pairs
  are compared in full.

A shard gives a spanning forest of its links, never all pairs, and distributed
connected components put the forests together.

Where texts are dropped (``drop_near_duplicates``), distances only propose
pairs, and a link is a pair whose whole sets of shingles are similar enough.
There the fingerprints are first partitioned by another distance, that of their
sets from the empty set, which is the set's size: sizes of similar sets differ by
a known factor at most, so a set meets those of its own and the next band only.

Edge cases: null, empty and blank texts have fingerprint zero and are linked
like any other; a text of fewer words than a shingle is one shingle; rows with
a null id join their group, whose class is the least id that isn't null (null
if there is none); repeated rows get the same class; an empty table gives an
empty result; columns other than the id and the text are ignored, or kept where
rows are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import arrow_schema, map_batches, release, struct_of, unused, utf8
from .components import connected_components
from .storage import discard, saved

SHINGLE = 4
RADIUS = 4
BROADCAST_ROWS = 300_000
SEED = 42

#: Share of the pairs at the similarity asked for that candidates must hold.
FOUND = 0.999

#: A trunk cell with more nodes is split by one more level.
SHARD_NODES = 30_000

#: Nodes asked of a shard that one task looks for; each slice of them has all
#: the shard's stored nodes.
ASKED_ROWS = 15_000

#: Nodes in a leaf, and pairs compared at once (few enough for a core's cache).
LEAF = 96
PAIRS_AT_ONCE = 1 << 16

#: Sets, and bytes that come with them, which one task of a band holds twice at
#: most: stored and asked.
PART_NODES = 100_000
PART_BYTES = 48_000_000

#: First bit and number of bits of the trunk's masks; after the last one the
#: bits are turned by ``_TURN`` places and the masks begin again.  A distance or
#: the lack of one is a digit of base ``_PLACES`` in a shard's number, which has
#: room for ``_DEEPEST`` digits and the slice.
_TRUNK = [(0, 16), (16, 16), (32, 8), (40, 8), (48, 8), (56, 8)]
_TURN = 21
_PLACES = 18
_DEEPEST = 12
_BRANCH_BITS = 4
_SLICES = 1 << 12


# -- fingerprints -----------------------------------------------------------


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's word shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # both work on ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles, zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    return print_of(shingle_hashes(text, shingle))


def candidate_radius(similarity: float, share: float = FOUND) -> int:
    """The least radius that holds this share of the pairs at the similarity,
    whose distances are binomial around the expected one."""
    apart = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    held = np.cumsum([comb(64, k) * apart**k * (1 - apart) ** (64 - k) for k in range(65)])
    return int(np.argmax(held >= min(share, held[-1])))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, h, fp) of every row: the text's hash, and the fingerprint's bits as
    a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            found = [fingerprint(t, shingle) for t in utf8(batch, "text")]
            return [batch.column("id"), batch.column("h"), pa.array(np.array(found, np.uint64).view(np.int64))]

        return work

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("h"),
        F.col(text_col).cast("string").alias("text"),
    )
    return map_batches(rows, make, "id long, h long, fp long")


# -- the tree ---------------------------------------------------------------


def _mask(first: int, bits: int) -> np.uint64:
    return np.uint64(((1 << bits) - 1) << first)


def _distance(fps: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ vantage) & mask).astype(np.int64)


def _turned(fps: np.ndarray, times: int) -> np.ndarray:
    """The fingerprints with their bits rotated ``times`` turns."""
    by = np.uint64(_TURN * times % 64)
    return (fps << by) | (fps >> (np.uint64(64) - by)) if by else fps


class Trunk:
    """The levels that deal nodes over shards; a shard is a path of distances.

    Every path goes through the first ``base`` levels; below, only the cells
    in ``split`` are divided once more."""

    def __init__(self, radius: int = RADIUS, split: set[int] | None = None):
        self.radius = radius
        self.base = 2 if radius <= RADIUS else 1
        self.split = split or set()
        self._split = np.array(sorted(self.split), np.int64)
        # Any vantage point will do: the bound holds for all.
        self.vantage = np.uint64(0x5555_3333_0F0F_00FF)

    @staticmethod
    def depth(shard: int) -> int:
        """Levels of a shard's path."""
        n = 0
        while shard:
            shard, n = shard // _PLACES, n + 1
        return n

    def _deeper(self, shards: np.ndarray, level: int) -> np.ndarray:
        if level < self.base:
            return np.ones(len(shards), bool)
        return np.isin(shards, self._split) if level < _DEEPEST else np.zeros(len(shards), bool)

    def place(self, fps: np.ndarray, asking: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, node, budget): a row for each shard that a node is asked of;
        a negative budget marks the row that stores it.

        Of two nodes the one that is nearer to the vantage point of the first
        level where their paths part is asked of the other's shard."""
        shard = np.zeros(len(fps), np.int64)
        budget, home = np.full(len(fps), self.radius), np.ones(len(fps), bool)
        done = []
        for level in range(_DEEPEST + 1):
            deeper = self._deeper(shard, level)
            done.append((shard[~deeper], fps[~deeper], np.where(home, -1, budget)[~deeper]))
            shard, fps, budget, home = (x[deeper] for x in (shard, fps, budget, home))
            if not len(fps):
                break
            turn, mask = divmod(level, len(_TRUNK))
            if mask == 0:  # other masks over all bits: a bound of its own
                budget = np.full(len(fps), self.radius)
            first, bits = _TRUNK[mask]
            here = _distance(_turned(fps, turn), self.vantage, _mask(first, bits))
            parts = []
            for step in range(-self.radius, self.radius + 1) if asking else (0,):
                there = here + step
                take = (there >= 0) & (there <= bits) & (abs(step) <= budget) & (~home | (step >= 0))
                parts.append(
                    (
                        shard[take] + (there[take] + 1) * _PLACES**level,
                        fps[take],
                        budget[take] - abs(step),
                        home[take] & (step == 0),
                    )
                )
            shard, fps, budget, home = (np.concatenate(x) for x in zip(*parts))
        return tuple(np.concatenate(x) for x in zip(*done))


class Slices:
    """How many slices the nodes asked of a shard are dealt over."""

    def __init__(self, asked: dict[int, int]):
        """``asked`` has the number of nodes asked of the shards with many."""
        many = sorted((k, min(_SLICES, -(-n // ASKED_ROWS))) for k, n in asked.items())
        self._shards = np.array([k for k, _ in many], np.int64)
        self._n = np.array([n for _, n in many], np.int64)

    def _of(self, shard: np.ndarray) -> np.ndarray:
        n = np.ones(len(shard), np.int64)
        if len(self._shards):
            at = np.minimum(np.searchsorted(self._shards, shard), len(self._shards) - 1)
            n = np.where(self._shards[at] == shard, self._n[at], 1)
        return n

    def deal(self, shard: np.ndarray, node: np.ndarray, budget: np.ndarray, radius: int):
        """(slice, node, budget) rows, with slices numbered within shards.  A
        stored node has a negative budget and stands in each slice of its shard;
        each shard that it is asked of, its own too, has it in one slice."""
        n, stored = self._of(shard), budget < 0
        asked_in = ((node ^ (node >> np.uint64(32))) % n.astype(np.uint64)).astype(np.int64)
        times = n[stored]
        each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return (
            np.concatenate([shard * _SLICES + asked_in, np.repeat(shard[stored], times) * _SLICES + each]),
            np.concatenate([node, np.repeat(node[stored], times)]),
            np.concatenate([np.where(stored, radius, budget), np.full(len(each), -1)]),
        )


class Forest:
    """Union of links between numbered nodes, with the least number as root.

    ``accept``, if given, decides on the pairs that would join two trees."""

    def __init__(self, n: int, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        self._up = list(range(n))
        self._accept = accept
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self._up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of the accepted pairs; pairs that come first are tried
        first.  Python walks over nodes and trees only, not over pairs."""
        while len(a):
            nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            tree = np.array([self.root(x) for x in nodes.tolist()], np.int64)[back]
            x, y = tree[: len(a)], tree[len(a) :]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            # Each tree's first pair.
            first = np.unique(np.unique(np.concatenate([x, y]), return_index=True)[1] % len(a))
            fits = np.ones(len(first), bool) if self._accept is None else self._accept(a[first], b[first])
            for i in first[fits].tolist():
                u, v = self.root(int(x[i])), self.root(int(y[i]))
                if u != v:
                    self._up[max(u, v)] = min(u, v)
                    self.edges.append((int(a[i]), int(b[i])))
            tried = np.ones(len(a), bool)
            tried[first] = False
            a, b = a[tried], b[tried]

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self._up))], np.int64)


class VantageTree:
    """The part of the tree within one shard, searched while it is built.

    ``fps`` are all fingerprints, ``stored`` the numbers of the shard's own
    nodes.  ``found`` gets the pairs within the radius."""

    def __init__(
        self, fps: np.ndarray, found: Callable[[np.ndarray, np.ndarray], None], radius: int, first_bit: int, leaf: int = LEAF
    ):
        self._fps, self._found, self._radius, self._leaf = fps, found, radius, leaf
        self._masks = [_mask(b, min(_BRANCH_BITS, 64 - b)) for b in range(first_bit, 64, _BRANCH_BITS)]

    def search(self, stored: np.ndarray, asked: np.ndarray, budget: np.ndarray) -> None:
        """Find each asked node's stored nodes within the radius."""
        todo = [(0, stored, asked, budget)]
        while todo:
            level, stored, asked, budget = todo.pop()
            if not len(stored) or not len(asked):
                continue
            if len(stored) <= self._leaf or level == len(self._masks):
                self._compare(stored, asked)
                continue
            mask = self._masks[level]
            vantage = self._fps[stored[len(stored) // 2]]
            here = _distance(self._fps[stored], vantage, mask)
            there = _distance(self._fps[asked], vantage, mask)
            for d in np.unique(here).tolist():
                left = budget - np.abs(there - d)
                near = left >= 0
                todo.append((level + 1, stored[here == d], asked[near], left[near]))

    def _compare(self, stored: np.ndarray, asked: np.ndarray) -> None:
        step = max(1, PAIRS_AT_ONCE // len(stored))
        fps = self._fps
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            close = np.bitwise_count(fps[some][:, None] ^ fps[stored][None, :]) <= self._radius
            i, j = np.nonzero(close)
            a, b = some[i], stored[j]
            differ = a != b
            if differ.any():
                self._found(a[differ], b[differ])


def shard_links(fps: np.ndarray, budget: np.ndarray, radius: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one slice as (fingerprint, least fingerprint of its tree)."""
    order = np.argsort(fps, kind="stable")
    fps, budget = fps[order], budget[order]
    values, number = np.unique(fps, return_inverse=True)
    forest = Forest(len(values))
    asking = budget >= 0
    turn, mask = divmod(depth, len(_TRUNK))
    left = budget[asking] if mask else np.full(int(asking.sum()), radius)
    tree = VantageTree(_turned(values, turn), forest.link, radius, _TRUNK[mask][0])
    tree.search(number[~asking], number[asking], left)
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(values)))
    return values[moved], values[roots[moved]]


def grow_trunk(nodes: DataFrame, radius: int) -> Trunk:
    """Split cells, level by level, until none has too many nodes.  Only the
    numbers of overfull cells come to the driver: less than one for each
    ``SHARD_NODES`` nodes."""
    split: set[int] = set()
    for level in range(Trunk(radius).base, _DEEPEST):
        cells = _dealt(nodes, Trunk(radius, split), asking=False).groupBy("shard").count()
        full = {r[0] for r in cells.filter(F.col("count") > SHARD_NODES).collect() if Trunk.depth(r[0]) == level}
        if not full:
            break
        split |= full
    return Trunk(radius, split)


def _dealt(nodes: DataFrame, trunk: Trunk, asking: bool, slices: Slices | None = None) -> DataFrame:
    """(shard, fp, budget): the nodes dealt over shards, or over their slices."""
    schema = struct_of("shard long, fp long, budget int")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                shard, fp, budget = trunk.place(fps, asking)
                if slices is not None:
                    shard, fp, budget = slices.deal(shard, fp, budget, trunk.radius)
                arrays = [pa.array(x, t) for x, t in zip((shard, fp.view(np.int64), budget), arrow_schema(schema).types)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema(schema))

    return nodes.select("fp").mapInArrow(place, schema)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that span the same
    classes as all pairs within ``radius`` bits.

    Before the nodes are dealt, those asked of each shard are counted; only the
    counts beyond ``ASKED_ROWS`` come to the driver."""
    trunk = grow_trunk(nodes, radius)
    asked = _dealt(nodes, trunk, asking=True).groupBy("shard").count().filter(F.col("count") > ASKED_ROWS)
    slices = Slices({r["shard"]: r["count"] for r in asked.collect()})

    def join(table: pa.Table) -> pa.Table:
        release()
        fps = table.column("fp").to_numpy().view(np.uint64)
        budget = table.column("budget").to_numpy()
        if not (budget < 0).any():
            fps, budget = fps[:0], budget[:0]
        shard = table.column("shard")[0].as_py()
        a, b = shard_links(fps, budget, radius, Trunk.depth(shard // _SLICES))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = _dealt(nodes, trunk, asking=True, slices=slices)
    return placed.groupBy("shard").applyInArrow(join, struct_of("a long, b long"))


# -- classes ----------------------------------------------------------------


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """(id, h, fp, component_id) of every row."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    found = connected_components(links(nodes, radius))
    # Linked nodes and their classes' least ids are written before they are
    # joined: with plain exchanges on both sides Spark can split a hot class.
    members = saved(
        nodes.join(found, F.col("fp") == F.col("node")).select("fp", "least", "component"), "simhash-members"
    )
    least = saved(members.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    linked = members.join(least, "component").select("fp", "component_id", "component")
    of_print = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fp").alias("component")
    )
    # Written for the same reason: one fingerprint may belong to many rows.
    of_print = saved(of_print, "simhash-classes")
    discard(nodes, members, least)
    return prints.join(of_print, "fp")


def simhash_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id`` (the
    least id reachable over links, its own included)."""
    return _classed(docs, id_col, text_col, shingle, radius).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


# -- verified classes -------------------------------------------------------


#: Bits of a set's parities for each shingle, at least.
PARITY_BITS = 4


def parity_of(hashes: np.ndarray) -> bytes:
    """A bit for each of ``PARITY_BITS`` to twice as many buckets a hash, a power
    of two: whether the bucket holds an odd number of them."""
    buckets = max(64, 1 << (PARITY_BITS * len(hashes) - 1).bit_length()) if len(hashes) else 64
    held = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Tells which sets can't be similar.

    A bucket whose parities differ holds a hash of one set only, and of sets
    with Jaccard similarity s such hashes are (n + m)(1 - s)/(1 + s)."""

    def __init__(self, n: np.ndarray, parity: list[bytes], similarity: float):
        self._n, self._similarity = n, similarity
        self._width = np.array([len(x) for x in parity], np.int64)
        self._row, self._folded = np.empty(len(n), np.int64), {}
        for width in np.unique(self._width).tolist():
            at = np.flatnonzero(self._width == width)
            self._row[at] = np.arange(len(at))
            whole = np.frombuffer(b"".join([parity[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)
            self._folded[width, width] = whole

    def _at(self, nodes: np.ndarray, width: int, to: int) -> np.ndarray:
        if (width, to) not in self._folded:
            x = self._folded[width, width]
            while x.shape[1] * 8 > to:
                half = x.shape[1] // 2
                x = x[:, :half] ^ x[:, half:]
            self._folded[width, to] = x
        return self._folded[width, to][self._row[nodes]]

    def may_be_similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair may have the similarity; no similar pair is ruled out."""
        n, s = self._n, self._similarity
        may = np.minimum(n[a], n[b]) >= s * np.maximum(n[a], n[b]) - 1e-9
        most = (n[a] + n[b]) * (1 - s) / (1 + s) + 1e-9
        shapes = np.where(may, self._width[a] << 32 | self._width[b], 0)
        for shape in np.unique(shapes[may]).tolist():
            v, w = shape >> 32, shape & 0xFFFFFFFF
            here = np.flatnonzero(shapes == shape)
            step = max(1, (1 << 22) // min(v, w))
            for at in range(0, len(here), step):
                some = here[at : at + step]
                x, y = self._at(a[some], v, min(v, w)), self._at(b[some], w, min(v, w))
                may[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[some]
        return may


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, h, fp, key, n, parity) of every row: the text's hash, and of its set
    of shingles the fingerprint, a hash, the size and the parities."""

    def make():
        import xxhash

        def work(batch: pa.RecordBatch) -> list:
            fp, key, n, parity = [], [], [], []
            for text in utf8(batch, "text"):
                hashes = np.unique(shingle_hashes(text, shingle))
                fp.append(print_of(hashes))
                key.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) >> 1)
                n.append(len(hashes))
                parity.append(parity_of(hashes))
            fps = pa.array(np.array(fp, np.uint64).view(np.int64))
            return [batch.column("id"), batch.column("h"), fps, key, n, parity]

        return work

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("h"),
        F.col(text_col).cast("string").alias("text"),
    )
    return map_batches(rows, make, "id long, h long, fp long, key long, n long, parity binary")


class Bands:
    """Sets dealt by size.  A band holds the sizes from one power of
    1 / similarity to the next; each set is stored in one part of its band and
    asked of the parts of its own band from its own on and of all parts of the
    next.  A band has as many parts, and the sets asked of a part as many slices,
    as keep each within ``PART_NODES`` sets and ``PART_BYTES`` bytes."""

    def __init__(self, similarity: float, sizes: dict[int, tuple[int, int]]):
        """``sizes`` has the number and the bytes of each band's sets."""
        self._similarity = similarity
        self._floors = self.floors(similarity)
        need = lambda n, size: max(1, -(-n // PART_NODES), -(-size // PART_BYTES))
        count = len(self._floors) + 1
        n, size = (np.array([sizes.get(k, (0, 0))[i] for k in range(-1, count)], np.int64) for i in (0, 1))
        self._parts = np.array([need(*x) for x in zip(n[1:].tolist(), size[1:].tolist())], np.int64)
        asked = zip((n[1:] + n[:-1]).tolist(), (size[1:] + size[:-1]).tolist())
        self._slices = np.array([need(*x) for x in asked], np.int64)

    @staticmethod
    def floors(similarity: float) -> list[float]:
        """The least size of each band; sets have less than 2 ** 40 shingles."""
        return [similarity**-k for k in range(int(np.ceil(40 * np.log(2) / -np.log(similarity))))]

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._floors, n, "right") - 1

    def deal(self, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, row, whether it is asked) of every copy of the rows given."""
        key = key.view(np.uint64)
        band, last = self.band(n), self.band(n / self._similarity * (1 + 1e-9))
        part = (key % self._parts[band].astype(np.uint64)).astype(np.int64)
        piece = key >> np.uint64(20)
        cells, rows, asked = [], [], []

        def put(at: np.ndarray, to_band: np.ndarray, to_part: np.ndarray, to_slice: np.ndarray, asks: bool) -> None:
            cells.append((to_band << 48) | (to_part << 24) | to_slice)
            rows.append(at)
            asked.append(np.full(len(at), asks))

        everything = np.arange(len(key))
        for i in range(int(self._slices[band].max(initial=0))):
            at = everything[self._slices[band] > i]
            put(at, band[at], part[at], np.full(len(at), i), False)
        for above in range(int((last - band).max(initial=0)) + 1):
            to = band + above
            for j in range(int(self._parts[to[last >= to]].max(initial=0))):
                at = everything[(last >= to) & (self._parts[to] > j) & ((above > 0) | (j >= part))]
                cut = (piece[at] % self._slices[to[at]].astype(np.uint64)).astype(np.int64)
                put(at, to[at], np.full(len(at), j), cut, True)
        return tuple(np.concatenate(x) for x in (cells, rows, asked))


def _in_bands(
    sets: DataFrame, carried: str, similarity: float, find: Callable[[pa.Table, Callable], list], result: str
) -> DataFrame:
    """``find(table, search)`` over the cells of all sets.  The table has the
    copies' ``fp``, ``key``, ``n`` and the binary column ``carried``;
    ``search(found)`` gives ``found`` all pairs of its rows within the candidate
    radius, each number standing for the first row of its key."""
    radius = candidate_radius(similarity)
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / -float(np.log(similarity)))
    # The rounding of this logarithm may move a set on a band's edge; only the
    # sums that say how many parts a band needs are made of it.
    sizes = sets.groupBy(band.cast("int").alias("band")).agg(
        F.count("*").alias("sets"), F.sum(F.octet_length(carried)).alias("bytes")
    )
    bands = Bands(similarity, {r["band"]: (r["sets"], r["bytes"]) for r in sizes.collect()})
    names = ["fp", "key", "n", carried]
    schema = struct_of(f"cell long, asked boolean, fp long, key long, n long, {carried} binary")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
                cell, row, asked = bands.deal(key, n)
                for some in range(0, len(cell), 8192):
                    cut = slice(some, some + 8192)
                    copies = part.take(pa.array(row[cut]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[cut]), pa.array(asked[cut]), *(copies.column(c) for c in names)],
                        schema=arrow_schema(schema),
                    )

    def join(table: pa.Table) -> pa.Table:
        release()
        keys, first, number = np.unique(table.column("key").to_numpy(), return_index=True, return_inverse=True)
        asks = table.column("asked").to_numpy()

        def search(found: Callable[[np.ndarray, np.ndarray], None]) -> None:
            fps = table.column("fp").to_numpy().view(np.uint64)[first]
            asked = number[asks]
            # At a radius this wide the bounds prune little, so leaves are large.
            tree = VantageTree(fps, found, radius, 0, leaf=2048)
            tree.search(number[~asks], asked, np.full(len(asked), radius))

        columns = find(table.take(pa.array(first)), search) if len(keys) > 1 and not asks.all() else None
        kinds = arrow_schema(struct_of(result))
        return pa.table(columns, schema=kinds) if columns is not None else kinds.empty_table()

    placed = sets.select(names).filter("n > 0").mapInArrow(place, schema)
    return placed.groupBy("cell").applyInArrow(join, struct_of(result))


def sets_with_candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """(key): the sets that have a candidate among the others.

    ``sets`` has ``fp``, ``key``, ``n`` and ``parity``."""

    def find(table: pa.Table, search: Callable) -> list:
        n = table.column("n").to_numpy()
        parities = Parities(n, table.column("parity").to_pylist(), similarity)
        paired = np.zeros(len(n), bool)

        def found(a: np.ndarray, b: np.ndarray) -> None:
            new = ~(paired[a] & paired[b])
            a, b = a[new], b[new]
            may = parities.may_be_similar(a, b)
            paired[a[may]] = paired[b[may]] = True

        search(found)
        return [table.column("key").to_numpy()[paired]]

    return _in_bands(sets, "parity", similarity, find, "key long").distinct()


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of keys with the similarity, of which each cell gives as
    many as span its classes.

    ``sets`` has ``fp``, ``key``, ``n`` and ``hashes``, the sorted hashes."""

    def find(table: pa.Table, search: Callable) -> list:
        n, keys = (table.column(c).to_numpy() for c in ("n", "key"))
        packed = table.column("hashes").to_pylist()
        hashes = [np.frombuffer(x, np.uint64) for x in packed]
        parities = Parities(n, [parity_of(x) for x in hashes], similarity)

        def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.array([jaccard(hashes[i], hashes[j]) >= similarity for i, j in zip(a.tolist(), b.tolist())], bool)

        forest = Forest(len(n), similar)

        def found(a: np.ndarray, b: np.ndarray) -> None:
            may = parities.may_be_similar(a, b)
            forest.link(a[may], b[may])

        search(found)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return [keys[edges[:, 0]], keys[edges[:, 1]]]

    return _in_bands(sets, "hashes", similarity, find, "a long, b long")


def similar_classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, h, component) of every distinct row, saved: the classes of similar sets.

    Fingerprints, sizes and parities first tell which sets have a candidate at
    all.  Only those go through the bands again, with their whole sets, and are
    compared in full there; no table of pairs is made."""
    prints = saved(shingle_sets(docs, id_col, text_col, shingle), "simhash")
    of_row = prints.select("id", "h", "key")
    if similarity >= 1:  # only equal sets
        return saved(of_row.withColumnRenamed("key", "component").distinct(), "simhash-classes")
    sets = prints.groupBy("key").agg(
        F.min("fp").alias("fp"), F.min("h").alias("h"), F.min("n").alias("n"), F.min("parity").alias("parity")
    )
    sets = saved(sets, "simhash-sets")
    wanted = saved(sets_with_candidates(sets, similarity).join(sets, "key").select("key", "h", "fp", "n"), "simhash-wanted")

    def make():
        def work(batch: pa.RecordBatch) -> list:
            packed = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in utf8(batch, "text")]
            return [*(batch.column(c) for c in ("fp", "key", "n")), packed]

        return work

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, "h").select("fp", "key", "n", "text")
    whole = map_batches(texts, make, "fp long, key long, n long, hashes binary", 256).dropDuplicates(["key"])
    whole = saved(whole, "simhash-whole")
    found = saved(connected_components(similar_links(whole, similarity)), "simhash-members")
    classed = of_row.join(found.withColumnRenamed("node", "key"), "key", "left")
    rows = saved(classed.select("id", "h", F.coalesce("component", "key").alias("component")).distinct(), "simhash-classes")
    discard(prints, sets, wanted, whole, found)
    return rows


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """``docs`` with one document of each class, all columns kept.

    Links are pairs whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``similarity`` or more; candidates are fingerprints of these
    sets within ``candidate_radius``.  The document with the least id stays (of several, that
    with the least text hash; rows equal in both stay together).  The others
    are taken out by an anti-join, broadcast only while they are at most
    ``BROADCAST_ROWS``."""
    rows = similar_classes(docs, id_col, text_col, shingle, similarity)
    # A null id comes after all others.
    rank = F.struct(F.col("id").isNull(), "id", "h")
    best = saved(
        rows.groupBy("component").agg(F.min(rank).alias("best"), F.count("*").alias("n")).filter("n > 1"),
        "simhash-best",
    )
    # The columns of ``docs`` may have any names.
    gone_id, gone_h = unused("gone_id", docs.columns), unused("gone_h", docs.columns)
    gone = saved(
        rows.join(best, "component").filter(rank != F.col("best")).select(
            F.col("id").alias(gone_id), F.col("h").alias(gone_h)
        ),
        "simhash-gone",
    )
    discard(rows, best)
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = (F.xxhash64(docs[text_col]) == F.col(gone_h)) & docs[id_col].cast("long").eqNullSafe(F.col(gone_id))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
