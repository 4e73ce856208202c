"""Vectors, exemplars and retrieval.

Exact inner-product top-k (X6), in blocks of bounded size:

1. Pivots, as many as suit the size of the corpus, are corpus rows picked by a
   hash; every corpus row goes to the bucket of its best pivot, and each bucket
   keeps its radius r_b = max ||x - p_b||. Buckets of pivots near one another make
   a tile of about ``max_block`` rows.
2. For a query q, every row of bucket b scores at most
   ub_b = q.p_b + ||q|| r_b (Cauchy-Schwarz), every row of a tile at most the
   highest bound of its buckets.
3. Pass 1 scores the ``probe`` tiles with the highest bound; the k-th best
   score t_q found (none if fewer than k rows were seen) goes with the query to
   pass 2, which scores only the other tiles whose bound reaches t_q and returns
   only scores of at least t_q. So the top k are exact (ties by id on scores
   rounded to 6 places).

Tiles are cut into chunks of at most about ``max_block`` rows and the queries
that probe a tile into blocks of ``max_queries``; each (tile, chunk, query
block) is one task's group, which returns at most k rows for each query. A hot
tile is many blocks. A Python task holds one batch of vectors and ``CELLS`` cells
of a matrix, whatever the size of the tables: which tiles a query probes is one
array for the query, and Spark makes the rows. On clustered vectors most tiles are
skipped; vectors without structure let the bound prune nothing, and the cost is
that of all products, |queries| x |corpus| x dimension, with every query sent to
|corpus| / max_block tiles and every corpus row to |queries| / max_queries blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlab.functions.constants import TAXONOMY
from answerlab.operators.quantiles import exact_quantiles
from answerlab.operators.ranking import join_null_safe
from answerlab.session import cut_lineage, literal_table


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, summed in order as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def normalise_vectors(df: DataFrame, col: str = "embedding", out: str | None = None) -> DataFrame:
    """Unit-norm vectors; a zero vector stays zero."""
    n = norm(F.col(col))
    return df.withColumn(out or col, F.transform(col, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def vector_length(df: DataFrame, vec: str) -> int | None:
    """The most frequent length of the vectors (the shortest of several); None
    without any. One row for each length comes to the driver."""
    first = (df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "d").first())
    return None if first is None else first["d"]


def searchable(vec: str, length: int) -> Column:
    """A vector of this length without a null or NaN; false for a null vector."""
    return F.coalesce((F.size(vec) == length) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))


#: Cells of a matrix (8 bytes each) that a task works on at a time.
CELLS = 1 << 20


def in_slices(pdf, width: int):
    """Parts of a batch with at most about ``CELLS`` cells for rows of ``width`` cells."""
    step = max(1, CELLS // max(1, width))
    for i in range(0, len(pdf), step):
        yield pdf.iloc[i:i + step]


def plain_vector(df: DataFrame, vec: str) -> Column:
    """The vector column as floats if it holds them (half the bytes to move), else as doubles."""
    return F.col(vec) if df.schema[vec].dataType.simpleString() == "array<float>" else F.col(vec).cast("array<double>")


def _assign_buckets(pivots, tile_of):
    """mapInPandas body: best pivot (highest inner product, lowest index on
    ties), its tile, and distance to it, for each corpus vector of the batch."""
    import numpy as np

    def run(batches):
        for pdf in batches:
            for part in in_slices(pdf, len(pivots)):
                x = np.stack(part["_cv"].to_numpy()).astype(np.float64)
                b = (x @ pivots.T).argmax(axis=1)
                yield part.assign(bucket=b.astype("int32"), tile=tile_of[b].astype("int32"), _d=np.sqrt(((x - pivots[b]) ** 2).sum(axis=1)))
    return run


def _probe_tiles(pivots, radii, tile_of, probe: int, second: bool):
    """mapInPandas body: the tiles each query probes, as one array for each query:
    best bounds first in pass 1, in pass 2 (``second``) the others whose bound reaches ``_t``."""
    import numpy as np

    buckets = np.array(sorted(radii, key=lambda b: (tile_of[b], b)), dtype=np.int64)
    radius = np.array([radii[int(b)] for b in buckets])
    tiles, begin = np.unique(tile_of[buckets], return_index=True)

    def run(batches):
        for pdf in batches:
            for part in in_slices(pdf, len(buckets)):
                q = np.stack(part["_qv"].to_numpy()).astype(np.float64)
                ub = q @ pivots[buckets].T + np.linalg.norm(q, axis=1)[:, None] * radius[None, :]
                ub = np.maximum.reduceat(ub, begin, axis=1)
                rank = np.argsort(np.argsort(-ub, axis=1, kind="stable"), axis=1)
                t = part["_t"].to_numpy(dtype=np.float64)
                reach = np.isnan(t)[:, None] | (ub >= np.nan_to_num(t)[:, None] - 1e-6)
                chosen = (rank >= probe) & reach if second else rank < probe
                yield part.assign(tiles=[tiles[row].astype("int32") for row in chosen])
    return run


def _block_topk(k: int, c_cols: Sequence[str]):
    """cogroup body: scores of one block by matrix products, some queries at a
    time; per query the top k of at least ``_t``, by (score rounded to 6 places
    desc, corpus id)."""
    import numpy as np
    import pandas as pd

    def run(qpdf, cpdf):
        names = ("query_id", "corpus_id", "score", *c_cols)
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({c: [] for c in names})
        x = np.stack(cpdf["_cv"].to_numpy()).astype(np.float64)
        ids = cpdf["corpus_id"].rank(method="first").to_numpy()
        found = []
        for part in in_slices(qpdf, len(x)):
            sc = np.round(np.stack(part["_qv"].to_numpy()).astype(np.float64) @ x.T, 6)
            least = part["_t"].to_numpy(dtype=np.float64)
            least = np.where(np.isnan(least), -np.inf, least - 1e-6)
            if sc.shape[1] > k:
                least = np.maximum(least, np.partition(sc, sc.shape[1] - k, axis=1)[:, sc.shape[1] - k])
            row, col = np.nonzero(sc >= least[:, None])  # the k best of a query and all ties of the last
            order = np.lexsort((ids[col], -sc[row, col], row))
            row, col = row[order], col[order]
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            keep = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) < k
            row, col = row[keep], col[keep]
            out = pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "corpus_id": cpdf["corpus_id"].to_numpy()[col],
                                "score": sc[row, col]})
            found.append(out.assign(**{c: cpdf[c].to_numpy()[col] for c in c_cols}))
        return pd.concat(found, ignore_index=True)
    return run


#: Memory that all pivots together may take in a task; it sets how fine the buckets are, nothing else.
PIVOT_BYTES = 32 << 20
#: (query, tile) rows that one task makes.
_TASK_ROWS = 200_000


def nearest_neighbours(queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "vec_id", c_id: str = "vec_id",
                       vec: str = "embedding", n_pivots: int | None = None, probe: int = 2,
                       c_cols: Sequence[str] = (), max_block: int = 4096, max_queries: int = 4096) -> DataFrame:
    """Exact top-k corpus rows per query by inner product.
    Returns (query_id, corpus_id, score, rank, *c_cols); score is rounded to 6
    places, rank 1..k by (score desc, corpus_id). Ids may be of any type that
    orders; an empty corpus gives no rows. Rows whose vector is null, holds a null
    or NaN, or has not the most frequent length of the corpus are no neighbours,
    and as queries find nothing. ``n_pivots`` defaults to half the
    square root of the corpus size."""
    import math

    import numpy as np

    spark = queries.sparkSession
    q = queries.select(F.col(q_id).alias("query_id"), plain_vector(queries, vec).alias("_qv")).dropDuplicates(["query_id"])
    c = corpus.select(F.col(c_id).alias("corpus_id"), plain_vector(corpus, vec).alias("_cv"), *c_cols)
    q_kind, v_kind = (q.schema[x].dataType.simpleString() for x in ("query_id", "_qv"))
    kinds = {f.name: f.dataType.simpleString() for f in c.schema.fields}
    out_schema = f"query_id {q_kind}, corpus_id {kinds['corpus_id']}, score double" + "".join(f", `{x}` {kinds[x]}" for x in c_cols)
    length = vector_length(c, "_cv")
    if length is None:
        return spark.createDataFrame([], out_schema + ", rank int")
    q, c = q.where(searchable("_qv", length)), c.where(searchable("_cv", length))
    size = c.count()
    if not size:
        return spark.createDataFrame([], out_schema + ", rank int")
    wanted = n_pivots or max(1, min(math.isqrt(size) // 2, PIVOT_BYTES // (8 * length)))
    rows = c.select("corpus_id", "_cv").orderBy(F.xxhash64("corpus_id"), "corpus_id").limit(wanted).collect()  # the pivots
    pivots = np.array([r["_cv"] for r in rows], dtype=np.float64)
    # pivots near one another share a tile, so that a tile holds about max_block rows
    heads = pivots[:max(1, -(-size // max_block))]
    tile_of = np.concatenate([((p ** 2).sum(axis=1)[:, None] - 2 * p @ heads.T + (heads ** 2).sum(axis=1)).argmin(axis=1)
                              for p in np.array_split(pivots, -(-len(pivots) * len(heads) // CELLS))])
    cb = c.mapInPandas(_assign_buckets(pivots, tile_of), ", ".join(f"`{x}` {t}" for x, t in kinds.items()) + ", bucket int, tile int, _d double")
    stats = cb.groupBy("bucket").agg(F.max("_d").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # one row for each pivot at most
    radii = {r["bucket"]: r["r"] for r in stats}
    held = np.bincount(tile_of[[r["bucket"] for r in stats]], weights=[r["n"] for r in stats]).astype(int)
    chunks = spark.createDataFrame([(i, -(-int(n) // max_block)) for i, n in enumerate(held) if n], "tile int, _chunks int")
    cchunk = cb.drop("_d", "bucket").join(F.broadcast(chunks), "tile").withColumn("chunk", F.pmod(F.xxhash64("corpus_id"), "_chunks").cast("int")).drop("_chunks")
    q = q.repartition(-(-max(1, q.count()) * len(held) // _TASK_ROWS), "query_id")  # the rows of a task are many more than its queries

    def scored(known: DataFrame, second: bool) -> DataFrame:
        pairs = (known.mapInPandas(_probe_tiles(pivots, radii, tile_of, probe, second), f"query_id {q_kind}, _qv {v_kind}, _t double, tiles array<int>")
                 .select("query_id", "_qv", "_t", F.explode("tiles").alias("tile")))
        sides = pairs.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(max_queries)).cast("int").alias("_blocks"))  # one row for each tile
        left = (pairs.join(F.broadcast(sides), "tile").join(F.broadcast(chunks), "tile")
                .select("query_id", "_qv", "_t", "tile", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int").alias("qb"),
                        F.explode(F.expr("sequence(0, _chunks - 1)")).alias("chunk")))
        right = cchunk.join(F.broadcast(sides), "tile").select(
            *kinds, "tile", "chunk", F.explode(F.expr("sequence(0, _blocks - 1)")).alias("qb"))
        return (left.groupBy("tile", "chunk", "qb").cogroup(right.groupBy("tile", "chunk", "qb"))
                .applyInPandas(_block_topk(k, c_cols), out_schema))

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    first = scored(q.withColumn("_t", F.lit(None).cast("double")), False)
    first = cut_lineage(first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank"))
    kth = first.groupBy("query_id").agg(F.min("score").alias("_s"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    known = q.join(kth.select("query_id", F.col("_s").alias("_t")), "query_id", "left").select("query_id", "_qv", "_t")
    rest = scored(known, True)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diverse_neighbours(queries: DataFrame, corpus: DataFrame, label: str, k: int = 9, cap: int = 1, over: int = 5,
                       **kw) -> DataFrame:
    """Take the k*over nearest rows, keep at most ``cap`` per label in
    score order, then the first k. Equal to the greedy scan because the cap
    counts per label."""
    cands = nearest_neighbours(queries, corpus, k * over, c_cols=[label, *kw.pop("c_cols", ())], **kw)
    by_label = Window.partitionBy("query_id", label).orderBy(F.desc("score"), "corpus_id")
    overall = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return (cands.withColumn("_lr", F.row_number().over(by_label)).where(F.col("_lr") <= cap)
            .withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= k).drop("_lr"))


def neighbour_lists(neigh: DataFrame, label: str, decimals: int = 3) -> DataFrame:
    """Per query, labels and scores of the neighbours in rank order (comma
    joined, scores with ``decimals`` places) and their number."""
    s = F.array_sort(F.collect_list(F.struct("rank", F.col(label).cast("string").alias("l"), "score")))
    return neigh.groupBy("query_id").agg(
        F.array_join(F.transform(s, lambda x: x["l"]), ",").alias("retrieved_labels"),
        F.array_join(F.transform(s, lambda x: F.format_string(f"%.{decimals}f", x["score"])), ",").alias("retrieved_sims"),
        F.size(s).alias("n_retrieved"))


def retrieval_quality(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X11: from saved comma lists, (query_id, sim) rows for every retrieved
    similarity with the per-query mean, and label counts of retrieved rows."""
    sims = (lists.select("query_id", F.explode(F.split("retrieved_sims", ",")).alias("s"))
            .select("query_id", F.expr("try_cast(s as double)").alias("sim")).where(F.col("sim").isNotNull()))
    sims = sims.withColumn("mean_sim", F.avg("sim").over(Window.partitionBy("query_id")))
    labels = (lists.select(F.explode(F.split("retrieved_labels", ",")).alias("label")).where(F.col("label") != "")
              .groupBy("label").agg(F.count(F.lit(1)).alias("n_retrieved")))
    return sims, labels


def neighbour_vote(neigh: DataFrame, label: str) -> DataFrame:
    """C4: label with most neighbours per query; ties -> higher best score,
    then smaller label. Groups hold at most k rows per query."""
    per = neigh.groupBy("query_id", F.col(label).alias("_l")).agg(
        F.count(F.lit(1)).alias("n_votes"), F.max("score").alias("_s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n_votes"), F.desc("_s"), "_l")
    return (per.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("query_id", F.col("_l").alias("voted_label"), "n_votes"))


def centroids(train: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Per-label mean vector: (label, centroid array<double>). One vector
    aggregate per label, combined on the map side, so a hot label is no hot task;
    vectors that cannot be searched (see :func:`searchable`) have no part."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    length = vector_length(train, vec) or 0
    usable = train.where(searchable(vec, length)).select(F.col(label).alias("label"), array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return usable.groupBy("label").agg(Summarizer.mean(F.col("_v")).alias("_m")).select("label", vector_to_array("_m").alias("centroid"))


def centroid_classifier(train: DataFrame, test: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """logits = inner product with each class centroid (classes in label
    order), prediction = label of the first maximum. Every row gets one logit
    for each class, so the list of centroids is as long as a row's result."""
    cents = centroids(train, label, vec).select(F.collect_list(F.struct("label", "centroid"))).scalar()
    sorted_c = F.sort_array(cents)  # by label; sort_array is not a lambda function
    return (test.withColumn("_c", sorted_c)
            .withColumn("logits", F.transform("_c", lambda c: dot(c["centroid"], F.col(vec))))
            .withColumn("pred_label", F.element_at("_c", F.array_position("logits", F.array_max("logits")).cast("int"))["label"])
            .drop("_c"))


# ----------------------------------------------------------------- exemplars

def median_exemplar(df: DataFrame, text: str, id_col: str, group: Sequence[str] = ()) -> DataFrame:
    """Per group, the row whose text length is nearest the group median
    (lowest id on ties). Returns (group.., id, length, median)."""
    ln = F.char_length(F.col(text))
    g = list(group)
    base = df.select(*g, id_col, ln.alias("_len"))
    med = exact_quantiles(base.select(*g, "_len"), "_len", [0.5], g, "_q").select(*g, F.col("_q")[0].alias("median"))
    j = join_null_safe(base, med, g) if g else base.withColumn("median", med.select("median").scalar())
    pick = j.groupBy(*g).agg(F.min_by(F.struct(id_col, "_len", "median"),
                                      F.struct(F.abs(F.col("_len") - F.col("median")), F.col(id_col))).alias("_p"))
    return pick.select(*g, F.col("_p")[id_col].alias(id_col), F.col("_p")["_len"].alias("length"),
                       F.col("_p")["median"].alias("median"))


def _taxonomy_df(spark, taxonomy: Sequence[tuple[str, str]]) -> DataFrame:
    return literal_table(spark, [(i, f, c) for i, (f, c) in enumerate(taxonomy)], ["_pos", "_fine", "_coarse"])


def exemplars_by_level(df: DataFrame, text: str, id_col: str, levels: dict[str, str]) -> DataFrame:
    """X2 over several label columns at once: ``levels`` maps a level name to its
    label column; every row is stacked once per level, so all levels come from
    one pass. Returns (level, label, id, length, median); null labels have none."""
    stacked = df.select(id_col, F.col(text), F.inline(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(c).alias("label")) for level, c in levels.items()])))
    return median_exemplar(stacked, text, id_col, ["level", "label"]).where(F.col("label").isNotNull())


def _first_per_coarse(stacked: DataFrame, id_col: str, taxonomy: Sequence[tuple[str, str]], fine_level: str) -> DataFrame:
    """Per coarse class: the exemplar of the first fine label (taxonomy order)
    that has one, else the exemplar of the coarse class (``fine`` null)."""
    tax = F.broadcast(_taxonomy_df(stacked.sparkSession, taxonomy))  # one row for each fine label
    is_fine = F.col("level") == fine_level
    tagged = (stacked.join(tax, is_fine & (F.col("label") == F.col("_fine")), "left")
              .select(F.when(is_fine, F.col("_coarse")).otherwise(F.col("label")).alias("coarse"),
                      F.when(is_fine, F.col("_pos")).otherwise(F.lit(len(taxonomy))).alias("_pos"),
                      F.struct(F.when(is_fine, F.col("label")).alias("fine"), F.col(id_col).alias("id")).alias("_x")))
    return (tagged.groupBy("coarse").agg(F.min_by("_x", "_pos").alias("_x")).where(F.col("coarse").isNotNull())
            .select("coarse", F.col("_x.fine").alias("fine"), F.col("_x.id").alias(id_col)))


def _stack(fine_ex: DataFrame, coarse_ex: DataFrame, id_col: str) -> DataFrame:
    return (fine_ex.select(F.lit("fine").alias("level"), F.col("fine").alias("label"), id_col)
            .unionByName(coarse_ex.select(F.lit("coarse").alias("level"), F.col("coarse").alias("label"), id_col)))


def collapse_stacked(stacked: DataFrame, id_col: str, taxonomy: Sequence[tuple[str, str]] = TAXONOMY,
                     fine_level: str = "fine") -> DataFrame:
    """X3 on stacked exemplars (level, label, id): (coarse, id, source), where
    source tells whether a fine or the coarse exemplar was found. One pass."""
    return _first_per_coarse(stacked, id_col, taxonomy, fine_level).select(
        "coarse", id_col, F.when(F.col("fine").isNotNull(), F.lit("fine")).otherwise(F.lit("coarse")).alias("source"))


def collapse_exemplars(fine_ex: DataFrame, coarse_ex: DataFrame, id_col: str,
                       taxonomy: Sequence[tuple[str, str]] = TAXONOMY) -> DataFrame:
    """Per coarse class, the exemplar of the first fine label (taxonomy
    order) that has one; classes without any take their coarse exemplar.
    In: fine_ex(fine, id), coarse_ex(coarse, id). Out: (coarse, id, source)."""
    return collapse_stacked(_stack(fine_ex, coarse_ex, id_col), id_col, taxonomy)


def one_shot_fine_label(coarse: Column, taxonomy: Sequence[tuple[str, str]] = TAXONOMY) -> Column:
    """First fine label mapping to a coarse label."""
    first: dict[str, str] = {}
    for f, c in taxonomy:
        first.setdefault(c, f)
    return F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[coarse]


def fine_stacked(stacked: DataFrame, id_col: str, taxonomy: Sequence[tuple[str, str]] = TAXONOMY,
                 fine_level: str = "fine") -> DataFrame:
    """X13 on stacked exemplars (level, label, id): (coarse, label, id). One pass."""
    return _first_per_coarse(stacked, id_col, taxonomy, fine_level).select(
        "coarse", F.coalesce("fine", one_shot_fine_label(F.col("coarse"), taxonomy)).alias("label"), id_col)


def fine_exemplar_per_coarse(fine_ex: DataFrame, coarse_ex: DataFrame, id_col: str,
                             taxonomy: Sequence[tuple[str, str]] = TAXONOMY) -> DataFrame:
    """Per coarse class, (first fine label with an exemplar, its exemplar);
    without any, the coarse exemplar tagged with the first fine label of the class."""
    return fine_stacked(_stack(fine_ex, coarse_ex, id_col), id_col, taxonomy)
