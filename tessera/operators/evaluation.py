"""Scores of predictions against truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_class(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, label, precision, recall, f1 (in percent, 0 where undefined) and support. rows: keys, y_true, y_pred; a null prediction is of no class.

    One aggregation to the confusion table, which has as many rows as pairs of labels.
    """
    keys = list(keys)
    cells = rows.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("y_true") == F.col("y_pred")
    own = cells.select(*keys, F.col("y_true").alias("label"), F.col("n").alias("support"), F.when(same, F.col("n")).otherwise(0).alias("hit"), F.lit(0).alias("said"))
    other = cells.where("y_pred is not null").select(*keys, F.col("y_pred").alias("label"), F.lit(0).alias("support"), F.lit(0).alias("hit"), F.col("n").alias("said"))
    t = own.unionByName(other).where("label is not null").groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "hit", "said")])
    p, r = _share("hit", "said"), _share("hit", "support")
    t = t.select(*keys, "label", "support", p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.select(*keys, "label", "precision", "recall", f1.alias("f1"), "support")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(0.0)


def metrics(rows: DataFrame, keys: list[str] = (), answered_only: bool = False) -> DataFrame:
    """keys, accuracy, precision, recall, f1_score (weighted by support), total, correct. answered_only leaves out null predictions."""
    keys = list(keys)
    rows = rows.where("y_pred is not null") if answered_only else rows
    key = keys or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    correct = F.sum(F.when(F.col("y_true") == F.col("y_pred"), 1).otherwise(0))
    whole = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), correct.alias("correct"))
    weighted = per_class(rows, key).groupBy(*key).agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")])
    return whole.join(weighted, key).select(*keys, (100.0 * F.col("correct") / F.col("total")).alias("accuracy"), "precision", "recall", F.col("f1").alias("f1_score"), "total", "correct")


def contingency(rows: DataFrame, by: str, across: str, values: list) -> DataFrame:
    """Counts of `by` x `across`; 0 where there are none."""
    return rows.groupBy(by).pivot(across, values).count().fillna(0)


def distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n, percent of the group."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    return n.join(total, group).select(group, value, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def paired(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers, by id; a missing hop count is 1, a missing variant Normal."""
    return questions.join(answers, "id").withColumns({"hop_count": F.coalesce("hop_count", F.lit(1)), "variant_type": F.coalesce("variant_type", F.lit("Normal"))})


def statistics(results: DataFrame) -> DataFrame:
    """A row for each q_type of results (q_type, hop_count, variant_type, y_true, y_pred): counts, accuracy over all in percent,
    the metrics of those answered, and by_hop and by_variant, arrays of key, total and correct in order. Small whatever the input:
    results are counted by type, hop count and variant first."""
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), 1).otherwise(0))
    cells = results.groupBy("q_type", F.coalesce(F.col("hop_count").cast("string"), F.lit("1")).alias("hop"), F.coalesce("variant_type", F.lit("Normal")).alias("variant")).agg(F.count(F.lit(1)).alias("n"), right.alias("right"), F.count("y_pred").alias("answered"))
    whole = cells.groupBy("q_type").agg(F.sum("n").alias("total"), F.sum("right").alias("correct"), (F.sum("answered") - F.sum("right")).alias("incorrect"), (F.sum("n") - F.sum("answered")).alias("no_response"))

    def by(key: str) -> DataFrame:
        each = cells.groupBy("q_type", key).agg(F.sum("n").alias("total"), F.sum("right").alias("correct"))
        return each.groupBy("q_type").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "total", "correct"))).alias(f"by_{key}"))

    m = metrics(results, ["q_type"], answered_only=True).select("q_type", F.struct("accuracy", "precision", "recall", "f1_score").alias("metrics"))
    out = whole.join(by("hop"), "q_type").join(by("variant"), "q_type").join(m, "q_type", "left")
    return out.select("q_type", "total", "correct", "incorrect", "no_response", (100.0 * F.col("correct") / F.col("total")).alias("accuracy"), "metrics", "by_hop", "by_variant")


def summary(results: DataFrame) -> str:
    """The metrics of each kind of question and of each of its classes as text. Rows are kinds and classes."""
    kinds = sorted(statistics(results).collect(), key=lambda r: r.q_type)
    classes = per_class(results.where("y_pred is not null"), ["q_type"]).collect()
    out = ["Evaluation", "=" * 70]
    for r in kinds:
        out += ["", f"{r.q_type} questions", "-" * 70, f"tested: {r.total}", f"answered: {r.total - r.no_response}", f"no response: {r.no_response}"]
        if r.metrics is not None:
            out += [f"{k}: {v:.2f}%" for k, v in r.metrics.asDict().items()]
        for c in sorted((c for c in classes if c.q_type == r.q_type), key=lambda c: str(c.label)):
            out.append(f"  {c.label}: support {c.support}, precision {c.precision:.2f}%, recall {c.recall:.2f}%, f1 {c.f1:.2f}%")
    return "\n".join(out)
