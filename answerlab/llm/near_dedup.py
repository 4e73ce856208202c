"""MinHash near-duplicates with sequential Bayesian verification.

1. Sketch: every text becomes its set of hashed word shingles, a 64-bit key of
   that set and 128 minimum hashes. Texts with equal sets are one class; only
   classes are compared, so exact copies never form pairs.
2. Candidates: 32 bands of 4 hashes. In every bucket, each class is paired with
   two centres (least and greatest key): at most two pairs per member.
3. Verification: the signatures of a pair are compared in batches of 32 hashes.
   After each batch the pair is dropped if, given the matches so far, the
   posterior probability of a similarity at the threshold or above is less than
   ``miss``. Survivors are verified exactly on their whole sets.
   Each set is sent once to a block of pairs, not once for every pair.
4. Links give components. Candidates give clusters (components of all candidate
   pairs). Only clusters that still hold several components are open: there,
   members outside the cluster's largest component meet the members of other
   components, in blocks of bounded size, together with their sets. Pairs that
   share a band take the same tests, best first, until their components are
   joined. So no link that could join two components is skipped, pairs inside a
   component are never looked at, and only links leave a block.

A pair at similarity 0.8 shares no band in 5 of 10^8 cases; ``miss`` is 10^-6.

Centres, buckets and components may be hot: grouped minima combine on the map
side, joins on hot keys are salted, blocks are bounded. Rounds are written to the
shared folder. Broadcast is only the list of classes to verify, after a count,
and by a shuffle join beyond ``broadcast_rows``.

Defined results: null text and texts without words have no shingles and are
linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows are one class; null ids take part, a component's id is its least
id that is not null; an empty table gives no rows; extra columns are ignored (or
kept, by :func:`drop_near_duplicates`), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm import words as W
from answerlab.llm.common import own_names, salted_join, stored
from answerlab.llm.components import components
from answerlab.session import ship_package

HASHES, BANDS, BATCH = 128, 32, 32
_ROWS = HASHES // BANDS
#: Members of a block of an open cluster; pairs of a verification block, about; text bytes of a slice.
_BLOCK, _PAIRS, _SLICE = 512, 5_000, 1 << 20

_MULTIPLY = W.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = W.mix(np.arange(1 << 20, (1 << 20) + HASHES, dtype=np.uint64))


def _shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of every text (A-Z as a-z)."""
    data, at = W.text_bytes(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
        part = data[at[i]:at[j]]
        starts, ends, first = W.spans(part, at[i:j + 1] - at[i])
        hashes = W.span_hashes(part, starts, ends, W.LOWER_BYTES)
        pos, values = W.window_hashes(hashes, first, width)
        cut = np.searchsorted(pos, first)
        for a, b, lo, hi in zip(first[:-1], first[1:], cut[:-1], cut[1:]):
            if b - a >= width:
                yield np.unique(values[lo:hi])
            elif b > a:  # the whole sequence as one shingle
                yield W.mix(np.array([np.bitwise_xor.reduce(W.mix(hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))]))
            else:
                yield np.zeros(0, np.uint64)
        i = j


def _signature(values: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(values), 1024):
        x = values[None, i:i + 1024] * _MULTIPLY[:, None]
        x += _ADD[:, None]
        low = np.minimum(low, (x.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return low


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for values in _shingle_sets(batch.column("text"), width):
                sizes.append(len(values))
                if len(values):
                    both = np.array([values.sum(), np.bitwise_xor.reduce(values)], np.uint64)
                    keys.append(int(W.mix(W.mix(both) * np.array([3, 5], np.uint64)).sum(dtype=np.uint64).astype(np.int64)))
                    signatures.append(_signature(values).tobytes())
                else:
                    keys.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                 pa.array(signatures, pa.binary())], ["doc_id", "row_key", "n_shingles", "key", "signature"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([x.tobytes() for x in _shingle_sets(batch.column("text"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), sets], ["key", "shingles"])
    return run


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch, the least number of equal hashes so far with which the
    similarity may still reach the threshold. With a uniform prior, m matches of
    n leave P(s >= t) = P(Binomial(n + 1, t) <= m)."""
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        least.append(m)
    return least


def _may_link(one: np.ndarray, many: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matches) of ``many`` that survive the sequential test against
    ``one`` (one signature, or one for each row)."""
    alive, matches = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, enough in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        other = one[cut] if one.ndim == 1 else one[alive, cut]
        matches = matches + (many[alive, cut] == other).sum(axis=1)
        ok = matches >= enough
        alive, matches = alive[ok], matches[ok]
    return alive, matches


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _prune(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows, _ = _may_link(_signatures(batch.column("sa")), _signatures(batch.column("sb")), least)
                yield batch.select(["a", "b", "member"]).take(pa.array(rows))
    return run


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _exact(percent: int):
    """Pairs of a block (a < b) that are links, from the sets of the block."""
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {k: np.frombuffer(x, np.uint64) for k, x in zip(sets["key"].to_pylist(), sets["shingles"].to_pylist())}
        linked = [_is_link(held[a], held[b], percent) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())]
        return pairs.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return run


def _open_block(least: list[int], percent: int):
    """Links between the minors of a block and its members of other components,
    as far as they join components: a pair is passed over once its components
    are joined, else it takes the sequential test and, best first, the exact one."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        minor, low, key = (table[c].to_numpy() for c in ("minor", "low", "key"))
        signature = _signatures(table["signature"])
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        _, part = np.unique(table["label"].to_numpy(), return_inverse=True)
        root = np.arange(part.max() + 1)
        members, links = np.flatnonzero(~minor), []
        for m in np.flatnonzero(minor):
            # another minor meets this one as well: the lesser key takes the pair
            others = members[(root[part[members]] != root[part[m]]) & (~low[members] | (key[members] > key[m]))]
            rows, matches = _may_link(signature[m], signature[others], least)
            rows = others[rows]
            banded = (signature[rows] == signature[m]).reshape(-1, BANDS, _ROWS).all(axis=2).any(axis=1)
            rows, matches = rows[banded], matches[banded]
            for r in rows[np.lexsort((key[rows], -matches))]:
                if root[part[r]] != root[part[m]] and _is_link(sets[m], sets[r], percent):
                    links.append((min(key[m], key[r]), max(key[m], key[r])))
                    root[root == root[part[r]]] = root[part[m]]
        return pa.table({"a": pa.array([int(a) for a, _ in links], pa.int64()), "b": pa.array([int(b) for _, b in links], pa.int64())})
    return run


def _verified(pairs: DataFrame, clusters: DataFrame, data: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """The links among ``pairs`` (a < b, distinct), by the sequential and then
    the exact test. Sets meet in blocks: all pairs of a cluster that fall into
    one block are verified in one group, to which each of their sets is sent
    once. A cluster with many pairs has many blocks, dealt by the hash of a pair's
    ``member``: the end that met the other as the least or greatest of a bucket, so
    it has at most two pairs a band. Blocks of a star are even then, however many
    pairs its centre has; only centres are sent to several blocks."""
    signed = pairs
    for end in "ab":
        signed = signed.join(data.select(F.col("key").alias(end), F.col("signature").alias(f"s{end}")), end)
    left = stored(signed.select("a", "b", "member", "sa", "sb").mapInArrow(_prune(least), "a long, b long, member long"), "pairs")
    placed = left.join(clusters.select(F.col("node").alias("a"), F.col("component").alias("g")), "a")
    sides = placed.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(_PAIRS)).cast("int").alias("_p"))
    blocks = salted_join(placed, sides, ["g"]).select("g", F.pmod(F.xxhash64("member"), "_p").alias("i"), "a", "b")
    wanted = blocks.select("g", "i", F.explode(F.array("a", "b")).alias("key")).distinct()
    sent = wanted.join(data, "key").select("g", "i", "key", "shingles").toDF("sg", "si", "key", "shingles")
    return stored(blocks.groupBy("g", "i").cogroup(sent.groupBy("sg", "si"))
                  .applyInArrow(_exact(percent), "a long, b long"), "links")


def _open_links(clusters: DataFrame, labels: DataFrame, data: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """Links that join components within the clusters that hold several."""
    m = (clusters.select(F.col("node").alias("key"), F.col("component").alias("g"))
         .join(labels.select(F.col("node").alias("key"), F.col("component").alias("_c")), "key", "left")
         .select("g", "key", F.coalesce("_c", "key").alias("label")))
    parts = m.groupBy("g", "label").agg(F.count(F.lit(1)).alias("_n"))
    sizes = (parts.groupBy("g").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "label")).alias("_top"), F.count(F.lit(1)).alias("_parts"))
             .where(F.col("_parts") > 1)
             .select("g", F.col("_top.label").alias("_major"), F.ceil(F.col("_all") / _BLOCK).cast("int").alias("_i"),
                     F.ceil((F.col("_all") - F.col("_top._n")) / _BLOCK).cast("int").alias("_j")))
    m = salted_join(m, sizes, ["g"]).withColumn("low", F.col("label") != F.col("_major")).join(data, "key")
    shown = ["g", "key", "label", "low", "signature", "shingles"]
    each = m.select(*shown, F.lit(False).alias("minor"), F.pmod(F.xxhash64("key"), "_i").cast("int").alias("i"),
                    F.explode(F.expr("sequence(0, _j - 1)")).alias("j"))
    minors = m.where("low").select(*shown, F.lit(True).alias("minor"), F.explode(F.expr("sequence(0, _i - 1)")).alias("i"),
                                   F.pmod(F.xxhash64("key", F.lit(1)), "_j").cast("int").alias("j"))
    return stored(each.union(minors).groupBy("g", "i", "j").applyInArrow(_open_block(least, percent), "a long, b long"), "links")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, row_key, n_shingles, key, signature`` per row, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(_keyed(docs).mapInArrow(_sketch(width), f"doc_id {kind}, row_key long, n_shingles long, key long, signature binary"), "sketch")


def near_links(docs: DataFrame, sketch: DataFrame, width: int, percent: int = 80, miss: float = 1e-6,
               broadcast_rows: int = 500_000) -> DataFrame:
    """``a, b``: edges between classes (keys of shingle sets) with the components
    of the links: components of the first links as stars, and the links that
    join them. ``docs`` has ``doc_id, text``."""
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(signature, i * {4 * _ROWS} + 1, {4 * _ROWS}), i))")
    rows = sketch.where("key is not null").select("key", F.posexplode(band).alias("band", "bucket"))
    ends = rows.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    members = stored(salted_join(rows, ends, ["bucket"]).distinct(), "members")
    keys = members.select("key").distinct()
    few = keys.count() <= broadcast_rows
    picked = stored(sketch.join(F.broadcast(keys) if few else keys, "key", "left_semi")
                    .groupBy("key").agg(F.min("row_key").alias("row_key"), F.min_by("signature", "row_key").alias("signature")), "classes")
    texts = _keyed(docs).join(F.broadcast(picked.select("key", "row_key")) if few else picked.select("key", "row_key"), "row_key")
    sets = texts.select("key", "text").mapInArrow(_sets(width), "key long, shingles binary").dropDuplicates(["key"])
    data = stored(picked.select("key", "signature").join(sets, "key"), "sets")

    stars = stored(members.select("key", F.explode(F.array("lo", "hi")).alias("c")).where("key <> c")
                   .groupBy(F.least("key", "c").alias("a"), F.greatest("key", "c").alias("b")).agg(F.min("key").alias("member")), "stars")
    clusters, least = components(stars), least_matches(percent / 100, miss)
    labels = components(_verified(stars, clusters, data, percent, least))
    return (labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            .union(_open_links(clusters, labels, data, percent, least)))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id",
                    text_col: str = "text", **limits: int) -> DataFrame:
    """One row per document: ``doc_id, row_key, n_shingles, key, class`` (least
    key of the component, null without shingles) and ``component_id``."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"doc_id": id_col, "text": text_col})
    sketch = sketches(own, width)
    parts = components(near_links(own, sketch, width, percent, miss, **limits))
    rows = sketch.select("doc_id", "row_key", "n_shingles", "key")
    labelled = salted_join(rows, parts.select(F.col("node").alias("key"), "component"), ["key"], how="left")
    labelled = labelled.withColumn("class", F.coalesce("component", "key")).drop("component")
    least = labelled.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("_least"))
    out = salted_join(labelled, least, ["class"], how="left")
    return out.select("doc_id", "row_key", "n_shingles", "key", "class",
                      F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def digest(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    found = near_components(docs, width, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                         **limits: int) -> DataFrame:
    """All columns of one document of each component (the least id; null ids
    last) and of every document without shingles."""
    found = stored(near_components(docs, width, percent, id_col=id_col, text_col=text_col, **limits)
                   .select("doc_id", "row_key", "class"), "components")
    first = (found.where("class is not null").groupBy("class")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("_f"))
             .select(F.col("_f.row_key").alias("_first")))
    # A row key that is kept, and how many equal rows have it.
    times = found.groupBy("row_key").agg(F.count(F.lit(1)).alias("_times"), F.max("class").alias("_class"))
    kept = (times.join(first, F.col("row_key") == F.col("_first"), "left")
            .where(F.col("_first").isNotNull() | F.col("_class").isNull())
            .select(F.col("row_key").alias("_kept"), (F.col("_first").isNotNull() & (F.col("_times") > 1)).alias("_many")))
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ident, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = named.withColumn("_row", F.xxhash64(ident, text)).join(kept, F.col("_row") == F.col("_kept"))
    one = rows.where("not _many").select(*named.columns)
    many = rows.where("_many").dropDuplicates(["_row"]).select(*named.columns)
    return one.union(many).toDF(*docs.columns)
