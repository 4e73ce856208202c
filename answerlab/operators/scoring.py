"""Scoring (C1, C2, C7) and resume checks.

C1 runs a user scorer (any model: pandas batch in, raw text out) inside
``mapInArrow``: one scorer per Python worker, which gets slices of about
``SLICE_BYTES`` of an Arrow batch, so that memory does not follow the length of the
texts. A failing batch is
cut in halves until the failing rows stand alone; these get ``ERROR: ...`` and
``PARSE_ERROR``, and the job goes on. So a scorer sees the good rows of a failing
batch again, log2(batch) times at most for each failing row; a scorer that is paid
by the call should remember its replies by row key. Label parsing happens
afterwards as native expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.functions.constants import PARSE_ERROR, TONES
from answerlab.functions.replies import reasoning_steps, with_reply_label
from answerlab.functions.text import truncate_chars, words

Scorer = Callable[[pd.DataFrame], pd.Series]


def _replies(scorer: Scorer, pdf: pd.DataFrame) -> list[str]:
    try:
        raw = [str(x) for x in scorer(pdf)]
        if len(raw) != len(pdf):
            raise ValueError(f"{len(raw)} replies for {len(pdf)} rows")
        return raw
    except Exception as exc:
        if len(pdf) == 1:
            return [f"ERROR: {exc}"]
        half = len(pdf) // 2
        return _replies(scorer, pdf.iloc[:half]) + _replies(scorer, pdf.iloc[half:])


#: Bytes of texts that a scorer gets at a time, about.
SLICE_BYTES = 4 << 20


def _scored_batches(scorer: Scorer, keep: Sequence[str]):
    """mapInArrow body: a batch goes to the scorer in slices of about
    ``SLICE_BYTES``; kept columns are passed on as they came."""
    def run(batches):
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                raw = pa.array(_replies(scorer, part.to_pandas()), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), raw], [*keep, "raw_output"])
    return run


def score_table(df: DataFrame, scorer: Scorer, keep: Sequence[str], labels: Sequence[str],
                answer: str | None = None, snippet_chars: int = 150, tagged: bool = False) -> DataFrame:
    """Raw reply per row from ``scorer``, parsed label (O1, or O3 with
    ``tagged``), optional answer snippet. ``keep`` columns are carried through.
    The tagged form adds ``reasoning`` (O4), empty for a failed row."""
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", raw_output string"
    scored = with_reply_label(df.mapInArrow(_scored_batches(scorer, [f.name for f in fields]), schema), "raw_output", labels,
                              "tagged" if tagged else "label", "_parsed")
    failed = F.col("raw_output").startswith("ERROR: ")
    scored = scored.withColumn("pred_label", F.when(failed, F.lit(PARSE_ERROR)).otherwise(F.col("_parsed"))).drop("_parsed")
    if tagged:
        scored = scored.withColumn("reasoning", F.when(failed, F.lit("")).otherwise(F.coalesce(reasoning_steps("raw_output"), F.lit(""))))
    if answer and answer in keep:
        scored = scored.withColumn("answer_snippet", truncate_chars(answer, snippet_chars, ellipsis=False))
    return scored


def lexicon_label(df: DataFrame, text: str, lexicon: DataFrame, id_col: str, tones: Sequence[str] = TONES,
                  out: str = "tone") -> DataFrame:
    """Sum of lexicon weights per tone over the lower-cased, punctuation-free
    tokens of the text; highest sum wins, list order on ties, so a text without
    hits gets the first tone. Adds ``out`` and ``tone_scores`` (tones in list
    order); ``id_col`` must be unique.

    Tokens are joined to the lexicon by word (broadcast or shuffled as Spark's
    size check decides; a frequent word's rows are split by its skew handling)
    and summed by row on the map side, so only ids and sums move and the cost
    per token does not depend on the size of the lexicon."""
    toks = words(F.regexp_replace(F.lower(F.col(text)), r"(?U)[^\w\s]", ""))
    weight = F.col("weight").cast("double")
    per_word = lexicon.groupBy("word").agg(*[F.sum(F.when(F.col("tone") == t, weight).otherwise(0.0)).alias(f"_w{i}")
                                             for i, t in enumerate(tones)])
    hits = df.select(F.col(id_col).alias("_id"), F.explode(toks).alias("word")).join(per_word, "word")
    sums = hits.groupBy("_id").agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(tones))])
    scored = df.join(sums, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    s = [F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(len(tones))]
    best = F.greatest(*s) if len(s) > 1 else s[0]
    pick = F.coalesce(*[F.when(x == best, F.lit(t)) for x, t in zip(s, tones)])
    return scored.withColumn(out, pick).withColumn("tone_scores", F.array(*s)).drop("_id", *[f"_s{i}" for i in range(len(tones))])


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not scored yet (anti join on the row key, so repeated texts
    are kept apart)."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def is_complete(done: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row (n_done, n_input, complete) from one count over both tables."""
    both = done.select(F.lit(1).alias("d")).unionByName(inputs.select(F.lit(0).alias("d")))
    return (both.agg(F.count_if(F.col("d") == 1).alias("n_done"), F.count_if(F.col("d") == 0).alias("n_input"))
            .withColumn("complete", F.col("n_done") == F.col("n_input")))


def train_text_classifier(train: DataFrame, valid: DataFrame, text: str, label: str, weights: DataFrame | None = None,
                          reg_params: Sequence[float] = (0.0, 0.01), num_features: int = 1 << 18, max_iter: int = 50):
    """Hashed TF-IDF + multinomial logistic regression (class weights as
    ``weightCol``); the features are made once, one fit per setting, the best by validation macro F1 (the
    first on ties). Returns (validation metrics per setting with ``chosen``, the
    chosen fitted model)."""
    from pyspark import StorageLevel
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    from answerlab.operators.measures import metrics_row
    from answerlab.operators.stats import label_map
    from answerlab.session import literal_table

    lmap = label_map(train, label)  # alphabetical ids, one row per class
    ids = F.broadcast(lmap.select(F.col("label").alias(label), F.col("label_id").cast("double").alias("_y")))
    tr = train.join(ids, label)
    if weights is not None:
        tr = tr.join(F.broadcast(weights.select(F.col("label").alias(label), F.col("weight").alias("_w"))), label, "left") \
            .withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    else:
        tr = tr.withColumn("_w", F.lit(1.0))
    back = F.broadcast(lmap.select(F.col("label_id").cast("double").alias("prediction"), F.col("label").alias("pred_label")))
    labels = sorted(r["label"] for r in lmap.collect())  # one row per class
    features = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\s+", toLowercase=True),
                                HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
                                IDF(inputCol="_tf", outputCol="_x")]).fit(tr)  # the same for all settings
    seen, held = (features.transform(df).select(*cols).persist(StorageLevel.DISK_ONLY)
                  for df, cols in ((tr, ["_x", "_y", "_w"]), (valid, ["_x", label])))
    results, best = [], None
    for reg in reg_params:
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=reg, maxIter=max_iter,
                                   family="multinomial").fit(seen)
        pred = (model.transform(held).join(back, "prediction", "left")
                .select(F.col(label).alias("true_label"), "pred_label"))
        m = metrics_row(pred, labels).first()  # one row of numbers
        results.append((float(reg), *m))
        if best is None or (m["macro_f1"] or 0.0) > best[0]:
            best = (m["macro_f1"] or 0.0, len(results) - 1, PipelineModel(stages=[*features.stages, model]))
    seen.unpersist()
    held.unpersist()
    rows = [(*r, i == best[1]) for i, r in enumerate(results)]
    return literal_table(train.sparkSession, rows, ["reg_param", "n_rows", "accuracy", "macro_f1", "weighted_f1", "chosen"]), best[2]
