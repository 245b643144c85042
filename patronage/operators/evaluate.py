"""Splits, class weights and model quality on tables of labels and scores."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.config import DEFAULTS, Settings
from patronage.functions.ordering import average_ranks, global_row_number, positions, running_totals


# ---------------------------------------------------------------- splits and folds (seeded)
def _slot(key: Column, seed: int | str, slots: int) -> Column:
    digest = F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots


def stratified_parts(df: DataFrame, label: str, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``split`` (train / val / test) and ``fold``: within each label in the exact proportions, to the row.

    Rows of a label are put in the order of a seeded hash of their key; the first ones are train, the next val, the
    rest test, and train rows are dealt to the folds in turn. A null label is a label of its own. ``key`` is unique;
    the result does not depend on row order or layout.
    """
    marked = df.withColumns({"_slot": _slot(F.col(key), settings.seed, 1 << 32), "_label": F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))})
    placed = positions(marked, ["_slot", key], ["_label"], "_place")
    sizes = marked.groupBy("_label").agg(F.count(F.lit(1)).alias("_size")).select(F.col("_label").alias("_of"), "_size")
    placed = placed.join(sizes, F.col("_label") == F.col("_of"))
    upto = lambda share: F.round(F.col("_size") * F.lit(share))
    split = (F.when(F.col("_place") <= upto(settings.split_train), "train")
             .when(F.col("_place") <= upto(settings.split_train + settings.split_val), "val").otherwise("test"))
    return placed.select(*df.columns, split.alias("split"), F.pmod(F.col("_place") - 1, F.lit(settings.cv_folds)).cast("int").alias("fold"))


# ---------------------------------------------------------------- class weights
def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): balanced weights n / (k * n_class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("t")).select("t").scalar()
    return counts.withColumn("_t", totals).select(
        label, "n", (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str, weights: DataFrame, name: str = "weight") -> DataFrame:
    """Add the weight of each row's class, 1 where the class is unknown. ``weights``: of class_weights(), one row a class."""
    side = weights.select(F.col(label).alias("_class"), F.col("weight").alias("_weight"))
    return df.join(side, F.col(label) == F.col("_class"), "left").withColumn(name, F.coalesce("_weight", F.lit(1.0))).drop("_class", "_weight")


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives per positive."""
    pos = F.greatest(F.sum(F.col(label).cast("long")), F.lit(1))
    return df.agg(((F.count(F.lit(1)) - pos) / pos).alias("positive_weight"))


# ---------------------------------------------------------------- binary classification
def confusion(df: DataFrame, label: str, score: str, threshold: float | Column) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, precision, recall, f1 (0 where undefined)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, yes = F.col(label) == 1, F.col(score) >= thr
    c = df.agg(F.count_if(~y & ~yes).alias("tn"), F.count_if(~y & yes).alias("fp"),
               F.count_if(y & ~yes).alias("fn"), F.count_if(y & yes).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select("tn", "fp", "fn", "tp", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("int")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (roc_auc): exact rank-sum over distinct scores, ties count half."""
    ranked = running_totals(_score_counts(df, label, score), "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / F.lit(2.0)))
    return ranked.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def roc_auc_by(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """(by, roc_auc) of every group at once."""
    y = F.col(label).cast("int")
    counts = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    ranked = running_totals(counts, "score", ["neg"], by)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / F.lit(2.0)))
    return ranked.groupBy(*by).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def threshold_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tp, fp, fn, recall, f1) for each distinct score used as threshold."""
    curve = running_totals(_score_counts(df, label, score), "score", ["pos", "neg"], descending=True)
    total = curve.agg(F.sum("pos").alias("p")).select("p").scalar()
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    fn = F.col("_p") - tp
    return curve.withColumn("_p", total).select(
        F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.coalesce(F.try_divide(tp.cast("double"), F.col("_p").cast("double")), F.lit(0.0)).alias("recall"),
        F.when(tp > 0, 2.0 * tp / (2.0 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def best_threshold(df: DataFrame, label: str, score: str, min_recall: float) -> DataFrame:
    """One row (threshold, f1, recall): best F1 among thresholds that reach the recall, else best F1 of all;
    the lowest threshold on ties."""
    curve = threshold_curve(df, label, score)
    best = F.max(F.struct((F.col("recall") >= min_recall).alias("ok"), "f1", (-F.col("threshold")).alias("low"), "recall"))
    return curve.agg(best.alias("b")).select((-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"), F.col("b.recall").alias("recall"))


# ---------------------------------------------------------------- regression and multiclass
def regression_quality(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: mae, rmse, r2."""
    error = F.col(target) - F.col(prediction)
    return df.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
                  (1 - F.try_divide(F.avg(error * error), F.var_pop(target))).alias("r2"))


def multiclass_quality(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and the unweighted mean of the F1 of all classes seen in labels or predictions."""
    table = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("z")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("y") == F.col("z")
    sides = F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said")),
                    F.struct(F.col("z").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said")))
    per_class = (table.select(F.explode(sides).alias("s"), F.when(hit, F.col("n")).otherwise(0).alias("tp"))
                 .groupBy("s.c").agg(F.sum("s.actual").alias("actual"), F.sum("s.said").alias("said"), (F.sum("tp") / 2).alias("tp")))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), (F.col("actual") + F.col("said")).cast("double")), F.lit(0.0))
    return per_class.agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


# ---------------------------------------------------------------- comparison
def rank_models(rows: DataFrame) -> DataFrame:
    """Test rows of the churn task ranked per run by AUC, then recall."""
    by = Window.partitionBy("run_id").orderBy(F.col("roc_auc").desc(), F.col("recall").desc(), "model")
    return rows.withColumn("rank", F.row_number().over(by))


def comparison_table(log: DataFrame, run_id: str, display: Mapping[str, str] | None = None) -> DataFrame:
    """Model comparison out of the run log (see sources.runlog)."""
    names = ["cv_roc_auc_mean", "cv_roc_auc_std", "accuracy", "precision", "recall", "f1", "roc_auc", "threshold"]
    value = lambda k: F.try_element_at("metrics", F.lit(k)).try_cast("double")
    rows = log.where((F.col("run_id") == run_id) & (F.col("task") == "churn") & (F.col("split") == "test")).select(
        "run_id", "model", *[value(k).alias(k) for k in names], "train_time_sec")
    out = rank_models(rows).withColumnsRenamed({"cv_roc_auc_mean": "cv_auc_mean", "cv_roc_auc_std": "cv_auc_std"})
    if display:
        pairs = [F.lit(x) for kv in display.items() for x in kv]
        out = out.withColumn("model_name", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model")), F.col("model")))
    return out.drop("run_id")


# ---------------------------------------------------------------- agreement of two scores
def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (spearman): correlation of average ranks."""
    ra = average_ranks(df, a).select(F.col(a).alias("_va"), F.col("avg_rank").alias("_ra"))
    rb = average_ranks(df, b).select(F.col(b).alias("_vb"), F.col("avg_rank").alias("_rb"))
    return (df.join(ra, F.col(a) == F.col("_va")).join(rb, F.col(b) == F.col("_vb"))
            .agg(F.corr("_ra", "_rb").alias("spearman")))


def flagged_in_top(df: DataFrame, flag: str, other: str, key: str, share: float = 0.05) -> DataFrame:
    """One row (flagged, overlap): share of flagged rows among the top rows of another score."""
    ranked = global_row_number(df.withColumn("_down", -F.col(other)), "_down", key, "_rank")
    n_top = F.greatest(F.floor(F.lit(share) * df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()), F.lit(1))
    return ranked.withColumn("_n_top", n_top).agg(
        F.count_if(flag).alias("flagged"),
        F.avg(F.when(F.col(flag), (F.col("_rank") <= F.col("_n_top")).cast("double"))).alias("overlap"))
