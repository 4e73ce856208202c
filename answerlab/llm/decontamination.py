"""Benchmark decontamination by spaced-seed hashing (native DataFrame code only).

Texts become lists of lower-case words of letters and digits. A spaced seed is a
fixed mask over consecutive words; the hash at a position covers the words under
the mask's ones and ignores the others, so a changed word at a zero does not
break the match. The hashes of every position of every document are joined with
those of every benchmark item. A hit fixes the alignment of document and item;
along it, words are compared one to one, and the hit counts when some window of
``window`` item words (all of a shorter item) agrees in at least ``similarity``
of its words. A document with such a hit is contaminated.

The masks lose nothing: whichever words of a verifying window are changed, one
mask lies on unchanged words somewhere inside it. They are chosen by the words of
the window and the changes the rule allows (:func:`masks_for`), for the item
lengths that the benchmark holds, so items of one word and more are searched for
and documents are hashed only under masks that some item needs.

Scale: the probes, (hash, item, place) rows, are sent to all tasks while their
summed bytes are few enough (``broadcast_bytes``); beyond that they are joined by
a shuffle of (hash, place) rows, salted against frequent word sequences, and only
candidate documents meet their words again. Either way an item's words join the
hits, not the probes: they are sent to all tasks by the same bound on their own
bytes, else shuffled. All ways give the same rows.

Defined results: null or empty texts and items without words match nothing;
null item texts are no items; repeated rows get the same verdict each; empty
documents give no rows, an empty benchmark leaves all clean; extra columns are
ignored (or kept, by :func:`drop_contaminated`), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlab.llm.common import own_names

#: Word offsets under the ones of each mask, by words of the window and changed words.
_FOUR, _SPLIT, _FIVE = (0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 3, 4, 5)
MASKS = {(5, 1): ((0, 1, 2), (0, 1, 3)), (6, 1): (_FOUR, _SPLIT), (7, 1): (_SPLIT,), (8, 1): (_SPLIT,), (9, 1): (_FIVE,),
         (10, 2): (_FOUR, _SPLIT), (11, 2): (_FOUR, _SPLIT), (12, 2): ((0, 1, 2, 3, 4), _FIVE),
         (13, 2): ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))}


def masks_for(words: int, similarity: float) -> tuple[tuple[int, ...], ...]:
    """Masks that hit every window of so many words that the rule accepts. Beside
    the table: ``c`` changes leave a run of a ``c + 1``-th of the equal words."""
    need = max(1, math.ceil(words * similarity - 1e-9))
    return MASKS.get((words, words - need)) or (tuple(range(-(-need // (words - need + 1)))),)


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _last(h: str, mask: tuple[int, ...]) -> str:
    return f"(size({h}) - {mask[-1] + 1})"


def _seeds(h: str, masks: dict, window: int | None = None) -> Column:
    """Hashes of all masks at all positions, mask by mask; with ``window``, of
    the masks that an item of this length needs."""
    each = []
    for number, (mask, sizes) in enumerate(masks.items()):
        parts = ", ".join(f"get({h}, i + {o})" for o in mask)
        last = _last(h, mask)
        used = f"{last} >= 0" + (f" and least(size({h}), {window}) in ({', '.join(map(str, sizes))})" if window else "")
        each.append(f"if({used}, transform(sequence(0, greatest({last}, 0)), i -> xxhash64({number}, {parts})), array())")
    return F.expr(f"concat({', '.join(each)})")


def _place(h: str, index: str, masks: dict, window: int | None = None) -> Column:
    """Position of the seed with this index in :func:`_seeds`."""
    out, first = "", "0"
    for mask, sizes in masks.items():
        used = f"least(size({h}), {window}) in ({', '.join(map(str, sizes))})" if window else "true"
        then = f"{first} + if({used}, greatest({_last(h, mask)} + 1, 0), 0)"
        out, first = out + f" when {index} < {then} then {index} - ({first})", then
    return F.expr(f"case{out} end")


def _agreement(window: int, similarity: float) -> tuple[Column, Column]:
    """(verified, agreeing words) of document ``_h`` and item ``_b`` aligned by
    ``_shift`` = document position minus item position."""
    same = F.expr("""transform(sequence(greatest(0, -_shift), least(size(_b), size(_h) - _shift) - 1),
                               j -> if(get(_h, j + _shift) = get(_b, j), 1, 0))""")
    wide = f"least({window}, size(_b))"
    need = f"ceil({wide} * {similarity} - 1e-9)"
    verified = F.expr(f"""size(_same) >= {wide} and exists(sequence(0, greatest(size(_same) - {wide}, 0)),
                          s -> aggregate(slice(_same, s + 1, {wide}), 0, (a, x) -> a + x) >= {need})""")
    return same, verified


def matches(docs: DataFrame, items: DataFrame, window: int = 13, similarity: float = 0.8,
            broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``_k, _id, item_id, matched_words``: one row per document and item with a
    verified overlap. ``docs`` has ``_id, _text``; ``items`` ``item_id, _text``."""
    bench = (items.where(F.col("_text").isNotNull()).dropDuplicates(["item_id", "_text"])
             .select("item_id", F.xxhash64("item_id", "_text").alias("_item"), _word_hashes(F.col("_text")).alias("_b")))
    id_bytes = F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 24
    lengths = (bench.groupBy(F.least(F.size("_b"), F.lit(window)).alias("n"))
               .agg(F.sum(F.size("_b").cast("long")).alias("words"), F.sum(id_bytes.cast("long") + 8 * F.size("_b")).alias("bytes"))
               .where("n > 0").orderBy("n").collect())  # one row for each length up to the window
    masks: dict = {}
    for n in [r["n"] for r in lengths] or [window]:
        for mask in masks_for(n, similarity):
            masks.setdefault(mask, []).append(n)
    # An upper bound: a mask begins at every word at most, a probe is its hash, its item's key and its place.
    probe_bytes = sum(20 * r["words"] * len(masks_for(r["n"], similarity)) for r in lengths)
    word_bytes = sum(r["bytes"] for r in lengths)
    probes = (bench.select("_item", "_b", F.posexplode(_seeds("_b", masks, window)).alias("_q", "_seed"))
              .select("_item", _place("_b", "_q", masks, window).alias("_q"), "_seed"))
    hashed = docs.select(F.xxhash64("_id", "_text").alias("_k"), "_id", _word_hashes(F.col("_text")).alias("_h"))
    seeds = hashed.select("_k", "_id", "_h", F.posexplode(_seeds("_h", masks)).alias("_p", "_seed"))
    if probe_bytes <= broadcast_bytes:
        hits = seeds.join(F.broadcast(probes), "_seed").withColumn("_p", _place("_h", "_p", masks))
        found = hits.select("_k", "_id", "_h", "_item", (F.col("_p") - F.col("_q")).alias("_shift"))
    else:
        salts = 16
        spread = seeds.withColumn("_p", _place("_h", "_p", masks)).select("_k", "_id", "_p", "_seed", F.pmod("_k", F.lit(salts)).alias("_salt"))
        copied = probes.select("_item", "_q", "_seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
        pairs = spread.join(copied, ["_seed", "_salt"]).select("_k", "_id", "_item", (F.col("_p") - F.col("_q")).alias("_shift")).distinct()
        back = hashed.select(F.col("_k").alias("_hk"), F.col("_id").alias("_hid"), "_h").dropDuplicates(["_hk", "_hid"])
        found = pairs.join(back, (F.col("_k") == F.col("_hk")) & F.col("_id").eqNullSafe(F.col("_hid")))
    found = found.join(F.broadcast(bench) if word_bytes <= broadcast_bytes else bench, "_item")
    same, verified = _agreement(window, similarity)
    return (found.withColumn("_same", same).where(verified)
            .groupBy("_k", "_id", "item_id").agg(F.max(F.aggregate("_same", F.lit(0), lambda a, x: a + x)).alias("matched_words")))


def _own(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    return (own_names(docs, {"_id": id_col, "_text": text_col}), own_names(benchmark, {"item_id": item_col, "_text": item_text}))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **limits: int) -> DataFrame:
    """One row per document: ``id_col, contaminated, n_items`` (benchmark items
    found), ``matched_words`` (most agreeing words with one item)."""
    own, items = _own(docs, benchmark, id_col, text_col, item_col, item_text)
    found = matches(own, items, window, similarity, **limits)
    per_doc = (found.groupBy(F.col("_k").alias("_fk"), F.col("_id").alias("_fid"))
               .agg(F.count(F.lit(1)).alias("_n"), F.max("matched_words").alias("_m")))
    keyed = own.select("_id", F.xxhash64("_id", "_text").alias("_k"))
    out = keyed.join(per_doc, (F.col("_k") == F.col("_fk")) & F.col("_id").eqNullSafe(F.col("_fid")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").isNotNull().alias("contaminated"),
                      F.coalesce("_n", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("_m", F.lit(0)).cast("long").alias("matched_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **limits: int) -> DataFrame:
    """The clean documents with all their columns."""
    own, items = _own(docs, benchmark, id_col, text_col, item_col, item_text)
    bad = matches(own, items, window, similarity, **limits).select(F.col("_k").alias("_fk"), F.col("_id").alias("_fid")).distinct()
    packed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ident, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    kept = (packed.withColumn("_k", F.xxhash64(ident, text))
            .join(bad, (F.col("_k") == F.col("_fk")) & F.col(ident).eqNullSafe(F.col("_fid")), "left_anti").drop("_k"))
    return kept.toDF(*docs.columns)
