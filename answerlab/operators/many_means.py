"""k-means with as many centres as a class must keep rows (R2a with k = target).

A class of n rows gets t clusters, where t may be in the millions, so no task and
no driver ever holds all centres:

1. *Upper levels.* A node above ``block`` rows is cut into up to 64 parts at once
   (fewer where that would leave a part less than some 8 centres):
   a bounded sample of its rows (the ``sample`` smallest hashes) is bisected at
   the means of its widest dimensions, and every row is routed down that small
   tree. Parts get centres in proportion to their rows. A level is one pass; 10^9
   rows need three.
2. *Blocks.* A node of at most ``block`` rows is one task: Lloyd iterations from
   several seeded starts (one is the bisection of the node, the others are
   distance-weighted draws), a cluster that runs empty takes the row furthest
   from its centre, and the start with the least cost is kept.

Every cluster has at least one row, also among equal rows. Results do not depend
on the order of rows: they are sorted by id first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlab.operators.neighbours import searchable, vector_length
from answerlab.operators.ranking import cut_lineage, join_null_safe

#: Parts of a node at most, and centres of a part on average at least.
FAN, CENTRES = 64, 8


def usable_vectors(df: DataFrame, vec: str) -> Column:
    """The vectors as doubles; one that is null, holds a null or NaN, or has not
    the most frequent length counts as the zero vector."""
    length = vector_length(df, vec) or 1
    return F.when(searchable(vec, length), F.col(vec).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), length))


def _cut(rows: np.ndarray) -> tuple[int, float] | None:
    """(dimension, value): rows at most the value go left; None among equal rows."""
    low, high = rows.min(0), rows.max(0)
    j = int(np.where(high > low, rows.var(0), -1.0).argmax())
    if not high[j] > low[j]:
        return None
    cut = max(rows[:, j].mean(), low[j])
    return (j, float(cut)) if cut < high[j] else (j, float(np.nextafter(high[j], low[j])))


def grow(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A tree over a sample: (dimension, cut, left, right) of inner nodes; a child
    below 0 is leaf -child - 1. The largest node is cut next. Without a cut, [(-1, 0, -1, -1)]."""
    tree: list[list] = []
    open_nodes = [(np.arange(len(x)), None)]
    done: list[tuple[np.ndarray, tuple | None]] = []
    while open_nodes and len(open_nodes) + len(done) < leaves:
        open_nodes.sort(key=lambda n: len(n[0]))
        at, parent = open_nodes.pop()
        cut = _cut(x[at]) if len(at) > 1 else None
        if cut is None:
            done.append((at, parent))
            continue
        me = len(tree)
        tree.append([cut[0], cut[1], 0, 0])
        if parent:
            tree[parent[0]][2 + parent[1]] = me
        left = x[at, cut[0]] <= cut[1]
        open_nodes += [(at[left], (me, 0)), (at[~left], (me, 1))]
    for _, parent in open_nodes + done:
        if parent:
            tree[parent[0]][2 + parent[1]] = -1
    walk, leaf = [(0, 3), (0, 2)] if tree else [], 0
    while walk:  # leaves are numbered from left to right: neighbours have neighbouring numbers
        node, side = walk.pop()
        child = tree[node][side]
        if child < 0:
            leaf += 1
            tree[node][side] = -leaf
        else:
            walk += [(child, 3), (child, 2)]
    return [tuple(t) for t in tree] or [(-1, 0.0, -1, -1)]


def route(x: np.ndarray, tree: list[tuple[int, float, int, int]]) -> np.ndarray:
    """Leaf of each row."""
    at = np.zeros(len(x), np.int64)
    t = np.array(tree, dtype=np.float64)
    if t[0, 0] < 0:
        return at
    while (at >= 0).any():
        rows = np.flatnonzero(at >= 0)
        node = t[at[rows]]
        left = x[rows, node[:, 0].astype(int)] <= node[:, 1]
        at[rows] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
    return -at - 1


def bisected(x: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf (0 to ``leaves`` - 1, none empty) of each row: nodes are cut at the
    mean of their widest dimension, equal rows anywhere; leaves go by size."""
    out = np.zeros(len(x), np.int64)
    open_nodes = [(np.arange(len(x)), 0, leaves)]
    while open_nodes:
        at, first, t = open_nodes.pop()
        if t == 1 or t == len(at):
            out[at] = first if t == 1 else first + np.arange(t)
            continue
        cut = _cut(x[at])
        left = x[at, cut[0]] <= cut[1] if cut else np.arange(len(at)) < len(at) // 2
        n1 = int(left.sum())
        t1 = min(max(round(t * n1 / len(at)), 1, t - (len(at) - n1)), n1, t - 1)
        open_nodes += [(at[left], first, t1), (at[~left], first + t1, t - t1)]
    return out


def _means(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    sums = np.zeros((k, x.shape[1]))
    np.add.at(sums, of, x)
    return sums / np.bincount(of, minlength=k)[:, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the squared distance, some rows at a time."""
    of, far = np.empty(len(x), np.int64), np.empty(len(x))
    norms, step = (centres ** 2).sum(1), max(1, (1 << 22) // len(centres))
    for i in range(0, len(x), step):
        d = norms[None, :] - 2 * x[i:i + step] @ centres.T
        of[i:i + step] = d.argmin(1)
        far[i:i + step] = np.maximum(0, d.min(1) + (x[i:i + step] ** 2).sum(1))
    return of, far


def _repaired(of: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Clusters without a row take the rows furthest from their centres, of clusters that can spare one."""
    size = np.bincount(of, minlength=k)
    empty = np.flatnonzero(size == 0)
    if len(empty):
        of = of.copy()
        for i in np.argsort(-far, kind="stable"):
            if size[of[i]] > 1:
                size[of[i]] -= 1
                of[i] = empty[0]
                empty = empty[1:]
                if not len(empty):
                    break
    return of


def cost(x: np.ndarray, of: np.ndarray) -> float:
    """Sum of squared distances to the cluster means."""
    _, of = np.unique(of, return_inverse=True)
    return float(((x - _means(x, of, int(of.max()) + 1)[of]) ** 2).sum())


def _drawn(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres drawn by squared distance to those before, up to 32 at a time."""
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        if not far.sum() > 0:
            chosen += rng.choice(len(x), k - len(chosen)).tolist()
            break
        new = np.unique(rng.choice(len(x), min(k - len(chosen), max(1, min(32, k // 16))), p=far / far.sum())).tolist()
        chosen += new
        far = np.minimum(far, _nearest(x, x[new])[1])
    return x[chosen[:k]]


def lloyd(x: np.ndarray, k: int, starts: int = 3, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Cluster (0 to k - 1, none empty) of each row: the cheapest of several starts."""
    if k >= len(x):
        return np.arange(len(x))
    best, least = bisected(x, k), np.inf
    if k == 1:
        return best
    rng = np.random.default_rng(seed)
    for s in range(starts):
        of = best.copy() if s == 0 else None
        centres = _means(x, of, k) if s == 0 else _drawn(x, k, rng)
        for _ in range(rounds):
            new, far = _nearest(x, centres)
            new = _repaired(new, far, k)
            if of is not None and (new == of).all():
                break
            of, centres = new, _means(x, new, k)
        now = cost(x, of)
        if now < least:
            least, best_now = now, of
    return best_now


def _trees(vec: str, label: str, block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        n, t = int(pdf["_n"].iloc[0]), int(pdf["_t"].iloc[0])
        # parts of half a block, with some centres each: k-means does not see across their borders
        tree = grow(np.stack(pdf[vec]).astype("float64"), max(2, min(FAN, -(-2 * n // block), t // CENTRES)))
        first = pdf.iloc[:1]
        return pd.DataFrame({label: first[label], "_lo": first["_lo"], "_tree": [[list(map(float, t)) for t in tree]]})
    return run


def many_means(df: DataFrame, targets: DataFrame, label: str, vec: str, out: str = "cluster", block: int = 8192, sample: int = 2048,
               starts: int = 3, seed: int = 42) -> DataFrame:
    """Rows of over-full classes (``targets``: label, n, target) with their
    cluster in ``out``, exactly ``target`` clusters a class."""
    t = targets.where(F.col("n") > F.col("target")).select(
        F.col("label").alias(label), F.col("n").alias("_n"), F.greatest(F.col("target"), F.lit(1)).alias("_t"))
    rows = join_null_safe(df, t, [label])
    base = cut_lineage(rows.withColumn("_v", usable_vectors(rows, vec)).withColumn("_row", F.monotonically_increasing_id()))
    kind = base.schema[label].dataType.simpleString()
    cur = base.select("_row", F.col(label).alias("_label"), "_v", F.lit(0).cast("long").alias("_lo"), "_t", "_n")
    node, shape = ["_label", "_lo"], f"_row long, _label {kind}, _v array<double>, _lo long, _t long, _n long"
    large = (F.col("_n") > block) & (F.col("_t") > 1)
    top = targets.agg(F.max("n")).first()[0] or 0  # a table of classes
    while top > block:
        big = cur.where(large)
        picked = (big.withColumn("_h", F.xxhash64("_row", F.lit(seed)))
                  .withColumn("_r", F.row_number().over(Window.partitionBy(*node).orderBy("_h", "_row"))).where(F.col("_r") <= sample))
        trees = picked.select("_row", *node, "_v", "_t", "_n").groupBy(*node).applyInPandas(
            _trees("_v", "_label", block), f"_label {kind}, _lo long, _tree array<array<double>>")
        routed = join_null_safe(big, trees, node).mapInPandas(_routed, shape + ", _part int")
        parts = routed.groupBy(*node, "_t", "_n", "_part").agg(F.count(F.lit(1)).alias("_s"))
        shares = parts.groupBy(*node, "_t", "_n").agg(F.sort_array(F.collect_list(F.struct("_part", "_s"))).alias("_parts"))  # FAN at most
        dealt = shares.mapInPandas(_dealt, f"_label {kind}, _lo long, _part int, _first long, _own long, _size long")
        moved = join_null_safe(routed, dealt, [*node, "_part"]).select(
            "_row", "_label", "_v", (F.col("_lo") + F.col("_first")).alias("_lo"), F.col("_own").alias("_t"), F.col("_size").alias("_n"))
        cur = cut_lineage(cur.where(~large).unionByName(moved))
        top = cur.where(large).agg(F.max("_n")).first()[0] or 0

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        found = lloyd(np.stack(pdf["_v"]).astype("float64"), int(pdf["_t"].iloc[0]), starts, seed=seed)
        return pd.DataFrame({"_row": pdf["_row"], out: (found + pdf["_lo"]).astype("int32")})

    leaf = (cur.where("_t > 1").select("_row", *node, "_v", "_t").groupBy(*node).applyInPandas(finish, f"_row long, `{out}` int")
            .unionByName(cur.where("_t = 1").select("_row", F.col("_lo").cast("int").alias(out))))
    # two numbers a row, written once: every later step would fit the blocks again
    return base.drop("_n", "_t", "_v").join(cut_lineage(leaf), "_row").drop("_row")


def _routed(batches):
    for pdf in batches:
        part = np.zeros(len(pdf), "int32")
        if not len(pdf):
            continue
        for at in pdf.groupby([pdf["_label"].map(repr), "_lo"]).indices.values():
            tree = [tuple(t) for t in pdf["_tree"].iloc[at[0]]]
            own = pdf.iloc[at]
            x = np.stack(own["_v"]).astype("float64")
            # equal rows: parted by a hash of the row, evenly
            part[at] = route(x, [(int(a), b, int(c), int(d)) for a, b, c, d in tree]) if tree[0][0] >= 0 else own["_row"] % FAN
        yield pdf.drop(columns="_tree").assign(_part=part)


def shared_out(sizes: list[int], centres: int) -> list[int]:
    """Centres for each part: by size, largest remainders first, at most one a
    row; each part gets at least one as long as there are enough (the largest first)."""
    total = sum(sizes)
    exact = [centres * s / total for s in sizes]
    out = [min(s, int(e)) for s, e in zip(sizes, exact)]
    order = sorted(range(len(sizes)), key=lambda i: (out[i] > 0, out[i] - exact[i], -sizes[i], i))
    while sum(out) < centres:
        for i in order:
            if sum(out) < centres and out[i] < sizes[i]:
                out[i] += 1
    return out


def _dealt(batches):
    """Centres and first cluster of each part. Parts without a centre join the part before (or behind) them."""
    for pdf in batches:
        rows = []
        for label, lo, centres, found in zip(pdf["_label"], pdf["_lo"], pdf["_t"], pdf["_parts"]):
            parts = [(int(p["_part"]), int(p["_s"])) for p in found]
            own = shared_out([s for _, s in parts], int(centres))
            groups: list[list] = []  # [parts, centres, rows]
            for (p, s), c in zip(parts, own):
                if c == 0 and groups:
                    groups[-1][0].append(p)
                    groups[-1][2] += s
                elif groups and groups[-1][1] == 0:
                    groups[-1][0].append(p)
                    groups[-1][1] += c
                    groups[-1][2] += s
                else:
                    groups.append([[p], c, s])
            first = 0
            for members, c, s in groups:
                rows += [(label, int(lo), p, first, c, s) for p in members]
                first += c
        yield pd.DataFrame(rows, columns=["_label", "_lo", "_part", "_first", "_own", "_size"]).astype({"_part": "int32"})
