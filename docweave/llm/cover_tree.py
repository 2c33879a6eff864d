"""Exact near-duplicate embeddings with cover trees and a dual traversal.

Unit vectors are compared by their chord: cosine >= c means a distance of at most sqrt(2 - 2c).
Inside a label the vectors are dealt to cells around centres, cells that are too large to cells of their own,
and so on: these are the upper levels of the tree, built by Spark without anything passing through the driver. Each
last cell is a block of bounded size, for which one task builds the lower levels, with halving radii, once. The
dual traversal starts with the roots, replaces a pair of nodes by the pairs of their children and drops those that their
covering radii keep further apart than the threshold: first as joins of the small table of upper nodes, then
inside each surviving pair of blocks.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import checkpoint, connected_components

LEAF = 48
#: Rows of a distance table that are computed at a time.
PAIR_ROWS = 512
#: Room for rounding in the bounds; pairs are decided by their cosine alone.
SLACK = 1e-6
#: Centres that a cell is split around at most, and rows of one cell that one task deals at a time.
FANOUT, DEAL, SALTS = 64, 20_000, 16
#: Levels of cells; what is too large even then is cut by a hash, which costs pruning but loses no pair.
LEVELS = 8


class CoverTree:
    """Nested levels: a node's points lie within its radius of its centre, and its centre is a child's centre too."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self.centre_at, self.radius_at = np.empty(0, int), np.empty(0)
        if len(points):
            self._build()

    def parts(self) -> dict[str, np.ndarray]:
        """The tree in five arrays: centres, radii, and for each node how many children or, at a leaf, members follow in ``inside``."""
        leaf = np.array([not len(c) for c in self.children], bool)
        inside = [m if is_leaf else c for c, m, is_leaf in zip(self.children, self.members, leaf, strict=True)]
        return {"centre": self.centre_at, "radius": self.radius_at, "leaf": leaf, "size": np.array(list(map(len, inside)), int), "inside": np.concatenate(inside) if inside else np.empty(0, int)}

    @classmethod
    def of_parts(cls, points: np.ndarray, parts: dict[str, np.ndarray]) -> CoverTree:
        """The tree that :meth:`parts` described."""
        tree, none = cls(points[:0]), np.empty(0, int)
        tree.points, tree.centre_at, tree.radius_at = points, parts["centre"], parts["radius"]
        inside = np.split(parts["inside"], np.cumsum(parts["size"])[:-1]) if len(parts["size"]) else []
        tree.members = [x if is_leaf else none for x, is_leaf in zip(inside, parts["leaf"], strict=True)]
        tree.children = [none if is_leaf else x for x, is_leaf in zip(inside, parts["leaf"], strict=True)]
        return tree

    def _node(self, centre: int, members: np.ndarray, dist: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(dist.max()) if len(dist) else 0.0)
        self.children.append(np.empty(0, int))
        self.members.append(members)
        return len(self.centre) - 1

    def _build(self) -> None:
        x = self.points
        everything = np.arange(len(x))
        dist = np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0))
        work = [(self._node(0, everything, dist), 2.0, dist)]
        while work:
            node, reach, dist = work.pop()
            members = self.members[node]
            if len(members) <= LEAF or self.radius[node] < 1e-7:
                continue
            half = reach / 2
            while half > 1e-7 and self.radius[node] <= half:  # the centre alone covers this level
                half /= 2
            rest, rest_dist, centre, kids = members, dist, self.centre[node], []
            while len(rest):
                near = rest_dist <= half
                kids.append((self._node(centre, rest[near], rest_dist[near]), half, rest_dist[near]))
                rest = rest[~near]
                if len(rest):
                    centre = int(rest[0])
                    rest_dist = np.sqrt(np.maximum(2 - 2 * (x[rest] @ x[centre]), 0))
                    rest_dist[0] = 0.0
            self.children[node] = np.array([k[0] for k in kids])
            work += kids
        self.centre_at = np.array(self.centre)
        self.radius_at = np.array(self.radius)


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) with a cosine of at least ``cosine``, in parts; i < j only, if the trees are one."""
    same = a is b
    if not len(a.points) or not len(b.points):
        return
    reach = np.sqrt(2 - 2 * cosine) + SLACK
    work = [(0, 0)]
    while work:
        p, q = work.pop()
        kids_p, kids_q = a.children[p], b.children[q]
        if not len(kids_p) and not len(kids_q):
            m, n = a.members[p], b.members[q]
            for at in range(0, len(m), PAIR_ROWS):
                i, j = np.nonzero(a.points[m[at : at + PAIR_ROWS]] @ b.points[n].T >= cosine)
                i, j = m[at + i], n[j]
                if same:
                    keep = i < j if p == q else np.ones(len(i), bool)
                    i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
                if len(i):
                    yield i, j
            continue
        kids_p = kids_p if len(kids_p) else np.array([p])
        kids_q = kids_q if len(kids_q) else np.array([q])
        centres = b.points[b.centre_at[kids_q]].T
        for at in range(0, len(kids_p), PAIR_ROWS):
            some = kids_p[at : at + PAIR_ROWS]
            d = np.sqrt(np.maximum(2 - 2 * (a.points[a.centre_at[some]] @ centres), 0))
            close = d <= a.radius_at[some][:, None] + b.radius_at[kids_q][None, :] + reach
            if same and p == q:
                close &= np.arange(at, at + len(some))[:, None] <= np.arange(len(kids_q))[None, :]
            i, j = np.nonzero(close)
            work += zip(some[i].tolist(), kids_q[j].tolist(), strict=True)


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


# ---- rows to distinct unit vectors


def _units(labels: pa.Array, vectors: pa.Array) -> pa.Array:
    """Struct node (digest of label and unit vector) and unit (bytes of doubles) of each row; null for what can't be compared."""
    n = len(vectors)
    unit: list[bytes | None] = [None] * n
    node: list[bytes | None] = [None] * n
    if isinstance(vectors.type, pa.LargeListType):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    sizes = np.diff(offsets)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
    names = labels.to_pylist()
    for size in np.unique(sizes[good & (sizes > 0)]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        x = values[offsets[rows][:, None] + np.arange(size)]
        largest = np.abs(x).max(axis=1)
        fine = np.isfinite(largest) & (largest > 0)
        rows, x = rows[fine], x[fine] / largest[fine][:, None]  # no overflow in the squares
        x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
        for i, line in zip(rows.tolist(), x, strict=True):
            unit[i] = line.tobytes()
            node[i] = hashlib.sha256(f"{names[i]}/".encode() + unit[i]).digest()[:20]
    return pa.StructArray.from_arrays([pa.array(node, pa.binary()), pa.array(unit, pa.binary())], names=["node", "unit"])


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, node, unit of every row; node and unit are null for what links with nothing.

    That is: null, empty or zero vectors, null or non-finite components, null labels, null ids.
    """

    def of(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for labels, vectors in parts:
            yield _units(labels, vectors)

    keys = F.arrow_udf(of, "node binary, unit binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vector"))
    rows = rows.select("id", "label", keys.asNondeterministic()("label", "vector").alias("k"))
    here = F.col("id").isNotNull()
    return rows.select("id", "label", F.when(here, F.col("k.node")).alias("node"), F.when(here, F.col("k.unit")).alias("unit"))


# ---- upper levels: cells


def _split_cells(dealt: DataFrame, block_size: int) -> DataFrame | None:
    """``dealt`` (label, dim, cell, node, unit) with every cell of over ``block_size`` rows split around centres of its own; None if there is none.

    A cell's centres are its rows with the smallest digests, at most ``FANOUT``. Rows meet them in groups of about ``DEAL``.
    """
    key = ["label", "dim", "cell"]
    large = checkpoint(dealt.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block_size))
    if large.isEmpty():
        return None
    wanted = large.select(*key, "n", F.least(F.lit(FANOUT), F.ceil(F.col("n") / block_size) + 1).alias("k"), F.ceil(F.col("n") / DEAL).cast("int").alias("groups"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")  # a hot cell is many groups of the join
    pool = dealt.withColumn("salt", salt).join(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "salt"])
    # about four candidates for each centre, by a hash, so that no group holds a hot cell
    share = pool.where(F.pmod(F.xxhash64("node", F.col("cell")), F.col("n")) < 4 * F.col("k"))
    centres = share.groupBy(*key, "k").agg(F.slice(F.array_sort(F.collect_list(F.struct("node", "unit"))), 1, FANOUT).alias("c"))
    centres = centres.select(*key, F.slice(F.col("c.unit"), F.lit(1), F.col("k").cast("int")).alias("centres"))
    sides = wanted.join(centres, key).select(*key, "groups", "centres", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    rows = pool.select(*key, "node", "unit", "copies", F.pmod(F.xxhash64("node"), "groups").cast("int").alias("group"))

    def deal(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({c: [] for c in ("label", "dim", "node", "unit", "copies", "cell")})
        out = mine[["label", "dim", "node", "unit", "copies"]].copy()
        cell = mine["cell"].iloc[0]
        if len(theirs):
            x = np.frombuffer(b"".join(mine["unit"]), np.float64).reshape(len(mine), -1)
            c = np.frombuffer(b"".join(theirs["centres"].iloc[0]), np.float64).reshape(-1, x.shape[1])
            out["cell"] = [f"{cell}/{i}" for i in (x @ c.T).argmax(axis=1)]
        else:
            out["cell"] = cell + "/0"
        return out

    full = [*key, "group"]
    theirs = sides.select(*[F.col(c).alias(f"their_{c}") for c in full], "centres").groupBy(*[f"their_{c}" for c in full])
    new = rows.groupBy(*full).cogroup(theirs).applyInPandas(deal, "label string, dim int, node binary, unit binary, copies long, cell string")
    rest = dealt.join(large.select(*key), key, "left_anti")
    return checkpoint(rest.unionByName(new))


def cells(classes: DataFrame, block_size: int) -> DataFrame:
    """``classes`` (label, node, unit, copies) with ``dim`` and ``cell``, a path; a cell has about ``block_size`` rows at most."""
    dealt = classes.select("label", (F.octet_length("unit") / 8).cast("int").alias("dim"), F.lit("r").alias("cell"), "node", "unit", "copies")
    for _ in range(LEVELS):
        split = _split_cells(dealt, block_size)
        if split is None:
            return dealt
        dealt = split
    key = ["label", "dim", "cell"]
    large = dealt.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block_size).select(*key, F.ceil(F.col("n") / block_size).cast("int").alias("groups"))
    cut = F.concat(F.col("cell"), F.lit("/h"), F.pmod(F.xxhash64("node"), F.coalesce("groups", F.lit(1))).cast("string"))
    return dealt.join(large, key, "left").withColumn("cell", F.when(F.col("groups").isNull(), F.col("cell")).otherwise(cut)).drop("groups")


_BLOCK = "label string, dim int, cell string, centre binary, radius double, nodes binary, copies binary, points binary, tree binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """A block: its mean and radius, its vectors and the cover tree over them."""
    group = group.sort_values("node")
    x = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
    first = group.iloc[0]
    return pd.DataFrame([[first["label"], first["dim"], first["cell"], centre.tobytes(), radius, b"".join(group["node"]), group["copies"].to_numpy(np.int64).tobytes(), x.tobytes(), _pack(CoverTree(x).parts())]], columns=[c.split()[0] for c in _BLOCK.split(", ")])


# ---- dual traversal of the upper levels


def _apart(a: pd.Series, b: pd.Series) -> np.ndarray:
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        out[i] = np.linalg.norm(np.frombuffer(x) - np.frombuffer(y))
    return out


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """A ball around balls: the mean of their centres."""
    c = np.stack([np.frombuffer(x) for x in group["centre"]])
    centre = c.mean(axis=0)
    radius = float((np.sqrt(((c - centre) ** 2).sum(axis=1)) + group["radius"].to_numpy()).max())
    first = group.iloc[0]
    return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "cell": [first["up"]], "centre": [centre.tobytes()], "radius": [radius]})


def block_pairs(heads: DataFrame, cosine: float) -> DataFrame:
    """Pairs ``label``, ``dim``, ``lo`` <= ``hi`` of blocks that may hold a link, by the dual traversal of the cells' paths.

    ``heads``: label, dim, cell, centre, radius of every block. A block above the deepest level is its own only child.
    """
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK

    @pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(_apart(a, b) <= r + s + reach)

    depth = heads.agg(F.max(F.size(F.split("cell", "/")))).first()[0] or 0
    levels = [heads.withColumn("up", F.substring_index("cell", "/", depth - 1))]
    for k in range(depth - 1, 0, -1):
        up = levels[0].groupBy("label", "dim", "up").applyInPandas(_merge, "label string, dim int, cell string, centre binary, radius double")
        levels.insert(0, checkpoint(up.withColumn("up", F.substring_index("cell", "/", k - 1) if k > 1 else F.lit(""))))
    if not levels or not depth:
        return heads.select("label", "dim", F.col("cell").alias("lo"), F.col("cell").alias("hi"))
    pairs = levels[0].select("label", "dim", F.col("cell").alias("lo"), F.col("cell").alias("hi"))
    for level in levels[1:]:
        side = lambda n: level.select("label", "dim", F.col("up").alias(n), F.col("cell").alias(f"{n}_cell"), F.col("centre").alias(f"{n}_centre"), F.col("radius").alias(f"{n}_radius"))  # noqa: B023, E731
        both = pairs.join(side("lo"), ["label", "dim", "lo"]).join(side("hi"), ["label", "dim", "hi"])
        both = both.where((F.col("lo") != F.col("hi")) | (F.col("lo_cell") <= F.col("hi_cell")))
        both = both.where(near("lo_centre", "hi_centre", "lo_radius", "hi_radius"))
        pairs = checkpoint(both.select("label", "dim", F.col("lo_cell").alias("lo"), F.col("hi_cell").alias("hi")))
    return pairs


# ---- dual traversal of pairs of blocks


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent`` (every entry a root) after the links i, j; only links between different roots cost anything."""
    a, b = parent[i], parent[j]
    while (new := a != b).any():
        a, b = np.maximum(a, b)[new], np.minimum(a, b)[new]
        np.minimum.at(parent, a, b)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        a, b = parent[a], parent[b]
    return parent


def _judge(cosine: float):
    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                names, copies = np.frombuffer(r.lo_nodes, "V20"), np.frombuffer(r.lo_copies, np.int64)
                one = other = CoverTree.of_parts(np.frombuffer(r.lo_points).reshape(-1, r.dim), _unpack(r.lo_tree))
                shift = 0
                if r.lo != r.hi:
                    other, shift = CoverTree.of_parts(np.frombuffer(r.hi_points).reshape(-1, r.dim), _unpack(r.hi_tree)), len(names)
                    names, copies = np.concatenate([names, np.frombuffer(r.hi_nodes, "V20")]), np.concatenate([copies, np.frombuffer(r.hi_copies, np.int64)])
                links, parent = np.zeros(len(names), np.int64), np.arange(len(names))
                for i, j in dual_pairs(one, other, cosine):
                    j = j + shift
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    parent = _join(parent, i, j)
                met = np.flatnonzero(links)
                yield pd.DataFrame({"node": [x.tobytes() for x in names[met]], "links": links[met], "other": [x.tobytes() for x in names[parent[met]]]})

    return of


def near_pairs(classes: DataFrame, cosine: float = 0.93, block_size: int = 4000) -> DataFrame:
    """Links among distinct unit vectors by pairs of blocks: ``node``, ``links`` (rows met, by ``copies``), ``other`` (a node reachable from it).

    ``classes``: label, node, unit, copies, one row per distinct vector of a label. A block is read once for
    each block that may hold a link with it; the pairs are dealt evenly before they are judged, and what a pair of blocks
    finds is summed up in its task, so that a group of many near vectors never becomes rows of pairs.
    """
    dealt = cells(classes, block_size)
    blocks = checkpoint(dealt.groupBy("label", "dim", "cell").applyInPandas(_build, _BLOCK))
    pairs = block_pairs(blocks.select("label", "dim", "cell", "centre", "radius"), cosine)
    side = lambda n: blocks.select("label", "dim", F.col("cell").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("nodes", "copies", "points", "tree")])
    both = pairs.join(side("lo"), ["label", "dim", "lo"]).join(side("hi"), ["label", "dim", "hi"])
    return both.repartition("label", "dim", "lo", "hi").mapInPandas(_judge(cosine), "node binary, links long, other binary")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, block_size: int = 4000) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` of every row.

    Vectors are compared within equal labels and equal lengths. Null, empty or zero vectors, vectors with
    a null or non-finite component and rows with a null label or id link with nothing: no links, their own
    component, kept. Equal vectors of a label collapse to one before the search and count as linked with each other.
    Repeated rows are rows of their own. An empty table returns no row. Other columns are ignored.
    """
    rows = checkpoint(unit_vectors(df, id_col, vec_col, label_col))
    classes = rows.where("node is not null").groupBy("label", "node", "unit").agg(F.min("id").alias("name"), F.count("*").alias("copies"))
    classes = checkpoint(classes)
    found = checkpoint(near_pairs(classes.select("label", "node", "unit", "copies"), cosine, block_size))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = classes.select("node", "name", "copies").join(links, "node", "left").join(groups, "node", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("name").alias("least"))
    named = named.join(least, "component", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "name").alias("component_id"))
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
