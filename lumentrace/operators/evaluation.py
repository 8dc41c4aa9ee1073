"""Scores of predictions against truth, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matches(pred: Column, truth: Column) -> Column:
    return F.when(pred.isNotNull() & (pred != "") & (pred == truth), 1).otherwise(0)


def set_prf(pred: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall, F1 of two distinct arrays; both empty is perfect, one empty is nothing."""
    np, nt = F.size(pred), F.size(truth)
    both = F.size(F.array_intersect(pred, truth))
    none = (np == 0) | (nt == 0)
    edge = F.when((np == 0) & (nt == 0), 1.0).when(none, 0.0)
    p, r = F.coalesce(edge, both / np), F.coalesce(edge, both / nt)
    return {"precision": p, "recall": r, "f1": F.coalesce(edge, F.when(both == 0, 0.0).otherwise(2 * p * r / (p + r)))}


def multiset_overlap(pred: DataFrame, truth: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per ``keys``: sum of the smaller counts over sum of the larger. Inputs have keys, item, n."""
    j = pred.withColumnRenamed("n", "n_pred").join(truth.withColumnRenamed("n", "n_true"), [*keys, item], "full")
    a, b = F.coalesce("n_pred", F.lit(0)), F.coalesce("n_true", F.lit(0))
    return j.groupBy(*keys).agg((F.sum(F.least(a, b)) / F.sum(F.greatest(a, b))).alias("overlap"))


def composite(event: Column, board: Column, board_f1: Column, alarm: Column, form: Column) -> Column:
    return 0.3 * event + 0.2 * board + 0.2 * board_f1 + 0.2 * alarm + 0.1 * form


def root_metrics(pred: Column, truth: Column) -> dict[str, Column]:
    """All roots named, share of them named, share of what is named that is no root; arrays are distinct."""
    both, np, nt = F.size(F.array_intersect(pred, truth)), F.size(pred), F.size(truth)
    return {
        "all_roots_identified": F.when(nt == 0, F.when(np == 0, 1.0).otherwise(0.0)).otherwise(F.when(both == nt, 1.0).otherwise(0.0)),
        "partial_root_accuracy": F.when(nt == 0, 1.0).otherwise(both / nt),
        "false_positive_rate": F.when((nt == 0) | (np == 0), 0.0).otherwise((np - both) / np),
    }


def example_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Means of score rows as ``per_example`` gives them, overall or by columns; roots over examples of several failures only."""
    means = {"event_accuracy": "event_correct", "board_accuracy": "board_correct", "category_accuracy": "category_correct", "board_f1_mean": "board_f1", "alarm_f1_mean": "alarm_f1", "severity_f1_mean": "severity_f1", "format_score_mean": "format_score", "e2e_score_mean": "e2e_score", "all_roots_identified": "all_roots_identified", "partial_root_accuracy": "partial_root_accuracy"}
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"), F.count("all_roots_identified").alias("n_multi_failure"), *[F.round(F.avg(c), 4).alias(n) for n, c in means.items()])


def main_results(runs: DataFrame, order: list[str], metrics: list[str]) -> DataFrame:
    """Last run of every method as rows (method, place, metric, value, best): known methods in order, others after them by name.

    ``best`` marks the largest value of a metric, if above zero; ties to the earlier place. The ranking reads a row per
    method and metric.
    """
    last = runs.groupBy("method").agg(F.max_by(F.struct(*metrics), F.struct("at", "run")).alias("m")).select("method", "m.*")
    known = F.coalesce(*[F.when(F.col("method") == m, i) for i, m in enumerate(order)], F.lit(len(order)))
    long = last.withColumn("place", known).unpivot(["method", "place"], metrics, "metric", "value")
    top = long.groupBy("metric").agg(F.min_by("method", F.struct(-F.col("value"), "place", "method")).alias("top"))
    return long.join(top, "metric").select("method", "place", "metric", "value", ((F.col("method") == F.col("top")) & (F.col("value") > 0)).alias("best"))


def uneven_groups(rewards: DataFrame, by: str, size: int) -> DataFrame:
    """Groups whose number of rewards is no multiple of ``size``: advantages over them are not defined."""
    return rewards.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % size != 0)


def training_curve(log: DataFrame) -> DataFrame:
    """Step, reward and loss of training logs (run, step, reward, reward_mean, mean_reward, loss): the first reward that is given and not 0
    counts, else the last one; entries without a step drop out, and so do runs without any reward and loss."""
    reward = F.coalesce(F.nullif("reward", F.lit(0.0)), F.nullif("reward_mean", F.lit(0.0)), "mean_reward")
    df = log.filter("step is not null").select("run", "step", reward.alias("reward"), "loss")
    some = df.groupBy("run").agg(F.count_if(F.col("reward").isNotNull() | F.col("loss").isNotNull()).alias("n")).filter("n > 0").select("run")
    return df.join(some, "run", "left_semi")


def training_logs(files: DataFrame) -> DataFrame:
    """The curve of raw logs (run, content): one object with a ``log_history``, or an object a line.

    A text that is no single object is read line by line, and lines that are none are skipped. Entries are variants, as logs name
    their fields differently: ``step`` or ``global_step``, ``loss`` or ``train_loss``, three names of rewards.
    """
    whole = files.withColumn("v", F.try_parse_json(F.trim("content")))
    nested = whole.filter("v is not null").select("run", F.explode(F.expr("try_variant_get(v, '$.log_history', 'array<variant>')")).alias("e"))
    lines = whole.filter("v is null").select("run", F.explode(F.split("content", "\n")).alias("line")).select("run", F.try_parse_json(F.trim("line")).alias("e")).filter("e is not null")
    get = lambda name, kind="double": F.expr(f"try_variant_get(e, '$.{name}', '{kind}')")
    named = lambda a, b, kind: F.when(F.expr(f"try_variant_get(e, '$.{a}', 'variant')").isNotNull(), get(a, kind)).otherwise(get(b, kind))
    rewards = [get(n).alias(n) for n in ("reward", "reward_mean", "mean_reward")]
    return training_curve(nested.unionByName(lines).select("run", named("step", "global_step", "long").alias("step"), *rewards, named("loss", "train_loss", "double").alias("loss")))


def per_count_table(rows: DataFrame, counts: list[int]) -> DataFrame:
    """Per method the accuracy at each number of failures, side by side; ``counts`` is a fixed list."""
    return rows.groupBy("method").pivot("n_failures", counts).agg(F.round(F.avg("correct"), 4))


def summary(scores: DataFrame) -> DataFrame:
    """Overall and per category in one pass; the overall row has category ``(all)``."""
    g = scores.rollup("category").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg(F.when(F.col("n_failures") > 1, F.col("correct"))).alias("multi_accuracy"))
    return g.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("category")).alias("category"), "n", "accuracy", "multi_accuracy")


def confusion(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.coalesce("truth", F.lit("(none)")).alias("truth"), F.coalesce("pred", F.lit("(none)")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(scores: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label, zero filled; ``labels`` is a fixed list."""
    counts = [F.count_if(F.col("pred") == x).alias(f"pred_{x.lower()}") for x in labels]
    rows = F.broadcast(scores.sparkSession.createDataFrame([(x,) for x in labels], "truth string"))
    return rows.join(scores.filter(F.col("truth").isin(*labels)).groupBy("truth").agg(*counts), "truth", "left").na.fill(0)


def top_confusions(scores: DataFrame, n: int) -> DataFrame:
    return confusion(scores).filter((F.col("truth") != F.col("pred")) & (F.col("truth") != "(none)")).orderBy(F.desc("n"), "truth", "pred").limit(n)


def compare_methods(scores: DataFrame) -> DataFrame:
    return scores.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.sum("correct").cast("long").alias("hits"))


def difficulty(scores: DataFrame, methods: list[str]) -> DataFrame:
    """How many methods solve an example: easy all, impossible none, hard one, medium between."""
    g = scores.groupBy("sample").agg(F.sum("correct").cast("int").alias("solved"))
    n = len(methods)
    return g.select("sample", "solved", F.when(F.col("solved") == n, "easy").when(F.col("solved") == 0, "impossible").when(F.col("solved") == 1, "hard").otherwise("medium").alias("difficulty"))


def advantage(scores: DataFrame, method: str) -> DataFrame:
    """Where one method alone is right, where it alone is wrong, and the difference."""
    own = F.max(F.when(F.col("method") == method, F.col("correct")))
    others = F.sum(F.when(F.col("method") != method, F.col("correct")))
    n = F.count_if(F.col("method") != method)
    g = scores.groupBy("sample").agg(own.alias("own"), others.alias("others"), n.alias("n"))
    g = g.agg(F.count_if((F.col("own") == 1) & (F.col("others") == 0)).alias("only_right"), F.count_if((F.col("own") == 0) & (F.col("others") == F.col("n"))).alias("only_wrong"))
    return g.select("only_right", "only_wrong", (F.col("only_right") - F.col("only_wrong")).alias("net"))


def method_pivot(scores: DataFrame, methods: list[str]) -> DataFrame:
    return scores.groupBy("category").pivot("method", methods).agg(F.avg("correct"))


def latest(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.max_by(F.struct("run", "score"), F.struct("at", "run")).alias("x")).select("model", "x.*")


def best_per_row(scores: DataFrame) -> DataFrame:
    """Best method of each category, only if above zero; ties to the smaller name."""
    g = scores.groupBy("category", "method").agg(F.avg("correct").alias("accuracy")).filter("accuracy > 0")
    return g.groupBy("category").agg(F.min_by("method", F.struct(-F.col("accuracy"), "method")).alias("best"), F.max("accuracy").alias("accuracy"))


def group_advantage(rewards: DataFrame, by: str, scale: bool = True) -> DataFrame:
    """Reward less the group's mean, over its deviation; nearly constant groups get 0."""
    w = W.partitionBy(by)
    sd = F.stddev_pop("reward").over(w)
    a = F.col("reward") - F.avg("reward").over(w)
    return rewards.withColumn("advantage", F.when(sd < 1e-4, 0.0).otherwise(a / (sd + 1e-8)) if scale else a)


def promotion_gate(metrics: DataFrame) -> DataFrame:
    """Candidates that meet the thresholds and do not fall behind the baseline."""
    ok = (F.col("event") >= 0.70) & (F.col("board_f1") >= 0.60) & (F.col("composite") >= 0.65) & (F.col("composite") >= F.col("baseline"))
    return metrics.withColumn("promoted", ok)


def split_delta(scores: DataFrame) -> DataFrame:
    """Accuracy of two splits side by side; an absent side counts as 0."""
    side = lambda s: scores.filter(F.col("split") == s).groupBy("method").agg(F.avg("correct").alias(s))
    j = side("iid").join(side("ood"), "method", "full")
    a, b = F.coalesce("iid", F.lit(0.0)), F.coalesce("ood", F.lit(0.0))
    return j.select("method", a.alias("iid"), b.alias("ood"), ((b - a) * 100).alias("delta"))


def ablation_delta(stages: DataFrame) -> DataFrame:
    """Change against the stage before in a fixed order; absent stages are skipped."""
    w = W.partitionBy("model").orderBy("stage_no")
    return stages.select("model", "stage_no", "score", (F.col("score") - F.lag("score").over(w)).alias("delta"))


def tool_calls(texts: DataFrame, id_col: str) -> DataFrame:
    """One row per ``ACTION: tool(args)`` in a text, in order."""
    found = F.regexp_extract_all("text", F.lit(r"ACTION:\s*(\w+)\("), F.lit(1))
    return texts.select(id_col, F.posexplode(found).alias("step", "tool"))


def tool_usage_bins(usage: DataFrame) -> DataFrame:
    """Accuracy by number of calls: [0,2), [2,4), [4,6), [6,...)."""
    b = F.when(F.col("calls") < 2, "0-1").when(F.col("calls") < 4, "2-3").when(F.col("calls") < 6, "4-5").otherwise("6+")
    return usage.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))
