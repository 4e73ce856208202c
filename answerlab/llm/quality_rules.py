"""Quality rules by cross-document line frequency (native DataFrame code only).

Lines are normalised (lower case, runs of blanks to one space, trimmed); the
distinct normalised lines of every document go to one row each, and the number
of distinct documents (by content, so exact copies count once) that hold a line
is counted per host. A line is removed from every document of its host when more
documents hold it than the host's limit: ``max_share`` of its documents, but
``min_docs`` at least (small hosts) and ``max_docs`` at most (large ones: a page
footer on a thousandth of a huge host is still a footer). A document is rejected when the lines that stay hold less than
``min_kept_share`` of the characters of its distinct normalised lines.

Skew: counting pre-aggregates on the map side; the join of lines to removed
lines is salted, so a line held by a third of all documents is spread.

Defined results: null or empty text has no words and no lines, fails the base
rules and is not kept; null host is a host of its own; repeated rows get the
same verdict each; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm.common import own_names, word_array

#: Words of a text up to which position and hash share one long.
_PACKED_WORDS = 1 << 20
_SALTS = 8

# Covered words of 3-word windows found at least twice. s: windows in hash
# order; windows with an equal neighbour are repeated; their positions, in
# order, cover min(3, distance to the next) words each.
_COVER = "aggregate(transform(_p, (p, j) -> least(3, coalesce(get(_p, j + 1), p + 3) - p)), 0, (a, x) -> a + x)"


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from ``_w`` (words) and ``n_words``; sorts inside
    the row, so nothing is shuffled and the cost is n log n for any text."""
    df = df.withColumn("_mask", F.expr("shiftleft(1L, length(bin(n_words))) - 1"))
    df = df.withColumn("_s", F.expr(f"""
        sort_array(if(n_words between 3 and {_PACKED_WORDS},
            transform(sequence(0, greatest(n_words, 3) - 3),
                      i -> (xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) & ~_mask) | i),
            array()))"""))
    # the packed hash is short of some bits: it only proposes windows, the full hash decides
    df = df.withColumn("_t", F.expr(f"""
        sort_array(transform(
            if(n_words > {_PACKED_WORDS},
               sequence(0, greatest(n_words, 3) - 3),
               transform(filter(_s, (x, j) -> coalesce((get(_s, j - 1) & ~_mask) = (x & ~_mask), false)
                                           or coalesce((get(_s, j + 1) & ~_mask) = (x & ~_mask), false)),
                         x -> cast(x & _mask as int))),
            i -> struct(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) as h, i as i)))"""))
    df = df.withColumn("_p", F.expr("""
        sort_array(transform(filter(_t, (x, j) -> coalesce(get(_t, j - 1).h = x.h, false)
                                               or coalesce(get(_t, j + 1).h = x.h, false)),
                             x -> x.i))"""))
    return df.withColumn("n_repeat_words", F.expr(_COVER).cast("long")).drop("_mask", "_s", "_t", "_p")


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` (``_text`` and others) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words and base_failed; ``_text`` is dropped."""
    lined = (docs.withColumn("_w", word_array(F.col("_text")))
             .withColumn("_l", F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"),
                                        lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    counted = (lined.withColumn("n_words", F.size("_w").cast("long"))
               .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
               .withColumn("n_symbols", F.regexp_count(F.coalesce(F.col("_text"), F.lit("")),
                                                       F.lit("[#*$%&|<>]")).cast("long"))
               .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
               .drop("_l", "_text")
               .withColumn("n_words", F.col("n_words").cast("int")))
    out = _repeat_words(counted).drop("_w").withColumn("n_words", F.col("n_words").cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < 50)
                          | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _norm_lines(text) -> "F.Column":
    """Distinct normalised non-empty lines of a text."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.array_remove(F.array_distinct(F.transform(F.split(flat, "\n"), lambda x: F.trim(x))), "")


def _row_key(id_col: str, host: str, text: str):
    """Equal for equal rows only: ids, and 64 bits over id, host and text."""
    return F.xxhash64(id_col, host, text)


def removed_lines(docs: DataFrame, min_docs: int = 2, max_share: float = 0.1, max_docs: int = 50) -> tuple[DataFrame, DataFrame]:
    """(lines, removed). lines: one row for each distinct normalised line of a
    document (``_id _k _host _h _len``). removed: ``_host _h`` of the lines above
    the limit. ``docs`` has ``_id _text _host``."""
    lines = (docs.select("_id", F.coalesce(F.col("_host"), F.lit("")).alias("_host"), F.col("_host").isNull().alias("_nohost"),
                         _row_key("_id", "_host", "_text").alias("_k"), F.xxhash64("_text").alias("_c"),
                         _norm_lines(F.col("_text")).alias("_l"))
             .select("_id", "_host", "_nohost", "_k", "_c",
                     F.explode(F.transform("_l", lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(x).alias("len")))).alias("_e"))
             .select("_id", "_host", "_nohost", "_k", "_c", F.col("_e.h").alias("_h"), F.col("_e.len").alias("_len")))
    hosts = (docs.groupBy(F.coalesce(F.col("_host"), F.lit("")).alias("_host"), F.col("_host").isNull().alias("_nohost"))
             .agg(F.count_distinct(F.xxhash64("_text")).alias("_docs")))
    held = (lines.groupBy("_host", "_nohost", "_h").agg(F.count_distinct("_c").alias("_n"))
            .where(F.col("_n") > min_docs))
    removed = (held.join(hosts, ["_host", "_nohost"])
               .where(F.col("_n") > F.least(F.lit(float(max_docs)), F.col("_docs") * F.lit(max_share))).select("_host", "_nohost", "_h", "_n"))
    return lines, removed


def _per_document(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """For each document with removed lines: how many distinct lines and
    characters go, and their hashes."""
    salted = removed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return (lines.withColumn("_salt", F.pmod("_k", F.lit(_SALTS)).cast("int"))
            .join(salted, ["_host", "_nohost", "_h", "_salt"])
            .dropDuplicates(["_id", "_k", "_h"])
            .groupBy("_id", "_k").agg(F.count(F.lit(1)).alias("_gone"), F.sum("_len").alias("_gone_chars"),
                                      F.collect_set("_h").alias("_hashes")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_docs: int = 2, max_share: float = 0.1, max_docs: int = 50, min_kept_share: float = 0.3) -> DataFrame:
    """One row per document: ``id_col``, the base measures, ``base_failed``,
    ``n_removed_lines``, ``line_chars`` (distinct normalised lines),
    ``removed_chars`` and ``kept``."""
    own = own_names(docs, {"_id": id_col, "_text": text_col, "_host": host_col})
    lines, removed = removed_lines(own, min_docs, max_share, max_docs)
    gone = _per_document(lines, removed).drop("_hashes")
    rows = base_measures(own.withColumn("_k", _row_key("_id", "_host", "_text"))
                         .withColumn("_chars", F.aggregate(F.transform(_norm_lines(F.col("_text")), F.char_length),
                                                           F.lit(0).cast("long"), lambda a, x: a + x)).drop("_host"))
    g = gone.select(F.col("_id").alias("_gid"), F.col("_k").alias("_gk"), "_gone", "_gone_chars")
    out = rows.join(g, (F.col("_k") == F.col("_gk")) & F.col("_id").eqNullSafe(F.col("_gid")), "left")
    removed_chars = F.coalesce(F.col("_gone_chars"), F.lit(0)).cast("long")
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.col("_gone"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.col("_chars").cast("long").alias("line_chars"), removed_chars.alias("removed_chars"),
        (~F.col("base_failed") & ((F.col("_chars") - removed_chars) >= F.col("_chars") * F.lit(min_kept_share))).alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_docs: int = 2, max_share: float = 0.1, max_docs: int = 50, min_kept_share: float = 0.3) -> DataFrame:
    """The kept documents with all their columns; lines above the limit are
    taken out of ``text_col``. Same decisions as :func:`judge`."""
    own = own_names(docs, {"_id": id_col, "_text": text_col, "_host": host_col})
    lines, removed = removed_lines(own, min_docs, max_share, max_docs)
    gone = (_per_document(lines, removed)
            .select(F.col("_id").alias("_gid"), F.col("_k").alias("_gk"), "_gone_chars", "_hashes"))
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    text = F.col("_row").getField(text_col)
    rows = packed.select(
        "_row", F.col("_row").getField(id_col).alias("_id"),
        F.xxhash64(F.col("_row").getField(id_col), F.col("_row").getField(host_col), text).alias("_k"),
        F.aggregate(F.transform(_norm_lines(text), F.char_length), F.lit(0).cast("long"), lambda a, x: a + x).alias("_chars"),
        text.alias("_text"))
    joined = base_measures(rows).join(gone, (F.col("_k") == F.col("_gk")) & F.col("_id").eqNullSafe(F.col("_gid")), "left")
    depleted = (F.col("_chars") - F.coalesce("_gone_chars", F.lit(0))) < F.col("_chars") * F.lit(min_kept_share)
    # One sum over both sides of the join, never null: a filter on base_failed alone, or a not-null
    # filter inferred from it, would be pushed into the projections below, where each level's
    # expression is copied into the next.
    out = joined.where(F.coalesce(F.col("base_failed").cast("int") + depleted.cast("int"), F.lit(1)) == 0)

    def norm(x):
        return F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09\x0B-\x0D]+", " "))

    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("_hashes"), F.xxhash64(norm(x)))), "\n")
    new_text = F.when(F.col("_hashes").isNull(), text).otherwise(kept)
    return out.withColumn("_new", new_text).select(
        *[F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in columns])
