"""Approximate nearest neighbours by inner product: a hashed vector index (X6 at scale).

Vectors are hashed by random hyperplanes into ``tables`` hash tables. Inner
products become angles first: a corpus vector x gets one more coordinate,
sqrt(M^2 - |x|^2) with M the longest norm, a query gets 0 there; then the order
by angle is the order by inner product.

A query probes, in every table, its own bucket and those that differ in the bits
of which it is least sure (smallest sum of squared margins first). How many, is
measured: for a bounded sample of queries the exact top k are found in one pass
over the corpus, and of all numbers of tables, bits and probes with which
``recall`` of them would be met, the cheapest are taken. So clustered vectors take
a probe or two of small buckets, and vectors without structure most of a few large
ones, since every further probe would send a query once more.

Candidates never become rows. Buckets are cut into chunks of at most about
``max_block`` vectors and the queries that probe them into blocks of
``max_queries``; a (bucket, chunk, block) is one matrix product in one task,
which returns at most k scored rows for a query. Scores are exact. A corpus
vector is sent once for each table and block of queries that probe its bucket,
whatever the number of queries elsewhere. A Python task holds one batch of vectors
and a bounded number of codes (``CELLS``): the buckets of a row are one array, and
Spark makes the rows.

Equal vectors are one: of a vector's rows only the k with the smallest ids can be
among the k nearest, and equal queries are searched once. So a vector that a
third of the rows hold is k rows.

Defined results: rows whose vector is null, holds a null or NaN, or has not the most
frequent length of the corpus are no neighbours, and as queries find nothing;
equal scores (6 places) are ordered by id; an empty corpus gives no rows; a query
has fewer than k rows only if its probes held fewer (``recall`` counts that).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlab.operators.neighbours import _TASK_ROWS, _block_topk, in_slices, plain_vector, searchable, vector_length

#: Bits with the smallest margins that probes may flip.
_FLIPS = 10
#: Vectors scored in the time that one is sent and laid out.
_SEND = 256


def _codes(x: np.ndarray, planes: np.ndarray, reach: float) -> np.ndarray:
    """Bucket numbers (rows, tables) of corpus vectors."""
    last = np.sqrt(np.maximum(0.0, reach * reach - (x * x).sum(axis=1)))
    side = np.einsum("nd,tdb->ntb", np.c_[x, last], planes) > 0
    return (side * (1 << np.arange(planes.shape[2]))).sum(axis=2)


def _probes(q: np.ndarray, planes: np.ndarray, most: int) -> np.ndarray:
    """Bucket numbers (rows, tables, probes) of queries, surest first."""
    bits = planes.shape[2]
    margin = np.einsum("nd,tdb->ntb", q, planes[:, :-1])
    code = ((margin > 0) * (1 << np.arange(bits))).sum(axis=2)
    unsure = np.argsort(np.abs(margin), axis=2)[:, :, :min(_FLIPS, bits)]
    cost = np.take_along_axis(margin, unsure, axis=2) ** 2
    sets = np.arange(1 << unsure.shape[2])
    member = (sets[:, None] >> np.arange(unsure.shape[2])[None, :]) & 1
    price = np.einsum("ntu,su->nts", cost, member)
    flips = np.einsum("ntu,su->nts", 1 << unsure, member)
    order = np.argsort(price, axis=2, kind="stable")[:, :, :most]
    return code[:, :, None] ^ np.take_along_axis(flips, order, axis=2)


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _hash_corpus(planes: np.ndarray, reach: float):
    """mapInPandas body: a vector's buckets, one of every table, as one array."""
    tables, _, bits = planes.shape
    table = np.arange(tables, dtype=np.int64) << bits

    def run(batches):
        for pdf in batches:
            for part in in_slices(pdf, tables * bits):
                yield part.assign(buckets=list(_codes(_stack(part["_cv"]), planes, reach) + table))
    return run


def _hash_queries(planes: np.ndarray, probes: int):
    """mapInPandas body: the buckets a query probes in all tables, as one array."""
    tables, _, bits = planes.shape
    table = np.arange(tables, dtype=np.int64)[:, None] << bits

    def run(batches):
        for pdf in batches:
            for part in in_slices(pdf, tables << min(_FLIPS, bits)):
                codes = _probes(_stack(part["_qv"]), planes, probes) + table
                yield part.assign(buckets=list(codes.reshape(len(part), -1)))
    return run


def _sample_topk(ids: list, q: np.ndarray, k: int):
    """mapInPandas body: the k best rows of each batch for every sampled query."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                sc = np.round(q @ _stack(pdf["_cv"]).T, 6)
                best = np.argsort(-sc, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(ids)), best.shape[1])
                yield pd.DataFrame({"query": row.astype("int32"), "score": sc[row, best.reshape(-1)], "_cv": pdf["_cv"].to_numpy()[best.reshape(-1)]})
    return run


def fit_probes(q: DataFrame, c: DataFrame, planes: np.ndarray, reach: float, k: int, recall: float, sample: int,
               n_queries: int, n_corpus: int, max_queries: int) -> tuple[int, int, int]:
    """(tables, bits, probes): of the shapes with which ``recall`` of the exact top k
    of at most ``sample`` queries (picked by a hash) would be found, the one with the
    least work: vectors scored, and vectors sent, which count ``_SEND`` times. The
    first tables and the first bits of ``planes`` make a smaller shape."""
    picked = q.select("_qv").orderBy(F.xxhash64("_qv")).limit(sample).collect()  # bounded by the parameter
    if not picked:
        return 1, 1, 1
    x = np.array([r["_qv"] for r in picked], dtype=np.float64)
    near = (c.select("_cv").mapInPandas(_sample_topk(list(range(len(x))), x, k), f"query int, score double, _cv {c.schema['_cv'].dataType.simpleString()}")
            .withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") <= k)
            .select("query", "_cv").collect())  # sample x k rows
    of, found = np.array([r["query"] for r in near]), np.array([r["_cv"] for r in near], dtype=np.float64)
    best = None
    for bits in range(1, planes.shape[2] + 1):
        some = planes[:, :, :bits]
        most = 1 << min(_FLIPS, bits)
        first = np.full((len(near), len(planes)), most)  # the probe of a table that finds a neighbour
        for i in range(0, len(x), 16):
            order = _probes(x[i:i + 16], some, most)
            at = np.flatnonzero((of >= i) & (of < i + 16))
            met = order[of[at] - i] == _codes(found[at], some, reach)[:, :, None]
            first[at] = np.where(met.any(axis=2), met.argmax(axis=2), most)
        first = np.minimum.accumulate(first, axis=1)
        place = max(0, int(np.ceil(recall * len(first))) - 1)
        for tables in range(1, len(planes) + 1):
            probes = int(np.sort(first[:, tables - 1])[place]) + 1
            sent = tables * probes + tables * n_corpus / n_queries * max(1.0, n_queries * probes / (1 << bits) / max_queries)
            cost = _SEND * sent + tables * probes * n_corpus / (1 << bits)
            if probes <= most and (best is None or cost < best[0]):  # few bits never miss: all their buckets can be probed
                best = cost, (tables, bits, probes)
    return best[1]


def hashed_neighbours(queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "vec_id", c_id: str = "vec_id", vec: str = "embedding",
                      tables: int = 16, bits: int | None = None, recall: float = 0.95, sample: int = 200, c_cols: Sequence[str] = (),
                      max_block: int = 4096, max_queries: int = 4096, seed: int = 17) -> DataFrame:
    """Nearly the k best corpus rows per query by inner product: ``query_id,
    corpus_id, score, rank, *c_cols``. At most ``tables`` tables of at most ``bits``
    bits, by default buckets of about 64 vectors; ``recall`` is the aim on a sample
    of ``sample`` queries."""
    spark = queries.sparkSession
    kept = corpus.select(F.col(c_id).alias("corpus_id"), plain_vector(corpus, vec).alias("_cv"), *c_cols)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    asked = queries.select(F.col(q_id).alias("query_id"), plain_vector(queries, vec).alias("_qv")).dropDuplicates(["query_id"])
    q_kind, v_kind = asked.schema["query_id"].dataType.simpleString(), asked.schema["_qv"].dataType.simpleString()
    out_schema = f"query_id {q_kind}, corpus_id {kinds['corpus_id']}, score double" + "".join(f", `{x}` {kinds[x]}" for x in c_cols)
    length = vector_length(kept, "_cv")
    if length is None:
        return spark.createDataFrame([], out_schema + ", rank int")
    same = Window.partitionBy("_cv").orderBy("corpus_id")
    c = kept.where(searchable("_cv", length)).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    asked = asked.where(searchable("_qv", length))
    q = asked.groupBy("_qv").agg(F.min("query_id").alias("query_id")).select("query_id", "_qv")
    norm2 = F.aggregate("_cv", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = c.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("m")).first()
    n_queries = q.count()
    if not size["n"] or not n_queries:
        return spark.createDataFrame([], out_schema + ", rank int")
    bits = bits or max(3, min(40, int(np.log2(max(1, size["n"]) / 64))))
    planes = np.random.default_rng(seed).normal(size=(tables, length + 1, bits))
    reach = float(np.sqrt(size["m"]))
    tables, bits, probes = fit_probes(q, c, planes, reach, k, recall, sample, n_queries, size["n"], max_queries)
    planes = planes[:tables, :, :bits]

    index = (c.mapInPandas(_hash_corpus(planes, reach), ", ".join(f"`{x}` {t}" for x, t in kinds.items()) + ", buckets array<long>")
             .select(*kinds, F.explode("buckets").alias("bucket")))
    # a query is many rows: its tasks are dealt by the rows they make
    probed = (q.repartition(-(-n_queries * tables * probes // _TASK_ROWS), "query_id").withColumn("_t", F.lit(None).cast("double"))
              .mapInPandas(_hash_queries(planes, probes), f"query_id {q_kind}, _qv {v_kind}, _t double, buckets array<long>")
              .select("query_id", "_qv", "_t", F.explode("buckets").alias("bucket")))
    key = ["bucket"]
    sides = (index.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / max_block).cast("int").alias("_chunks"))
             .join(probed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / max_queries).cast("int").alias("_blocks")), key))
    left = probed.join(sides, key).select("query_id", "_qv", "_t", *key, F.pmod(F.xxhash64("query_id"), "_blocks").cast("int").alias("block"),
                                          F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))
    right = index.join(sides, key).select(*kinds, *key, F.pmod(F.xxhash64("corpus_id"), "_chunks").cast("int").alias("chunk"),
                                          F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    block = [*key, "chunk", "block"]
    scored = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(_block_topk(k, c_cols), out_schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    found = (scored.groupBy("query_id", "corpus_id").agg(F.first("score").alias("score"), *[F.first(x).alias(x) for x in c_cols])
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    again = asked.select("query_id", F.col("_qv").alias("_v")).join(q.select(F.col("query_id").alias("_rep"), F.col("_qv").alias("_v")), "_v").drop("_v")
    return (found.withColumnRenamed("query_id", "_rep").join(again, "_rep")
            .select("query_id", "corpus_id", "score", *c_cols, "rank"))


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``n_queries, n_exact, n_found, recall``; a row counts as found if
    its score reaches the exact k-th (equal scores may stand for each other)."""
    least = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("_k"), F.min("score").alias("_least"))
    hits = (approximate.join(least, "query_id").groupBy("query_id")
            .agg(F.least(F.count_if(F.col("score") >= F.col("_least") - 1e-6), F.first("_k")).alias("_hits")))
    return (least.join(hits, "query_id", "left")
            .agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("_k"), F.lit(0)).alias("n_exact"),
                 F.coalesce(F.sum("_hits"), F.lit(0)).alias("n_found"))
            .withColumn("recall", F.when(F.col("n_exact") > 0, F.col("n_found") / F.col("n_exact")).otherwise(F.lit(1.0))))
