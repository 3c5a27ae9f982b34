"""Confidence models: logistic and Platt fits per family, thresholds, reliability. Fits see distinct feature vectors with counts;
scoring is native."""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import add

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.constants import ROUTES, TARGETS
from statera.functions import scalar as S
from statera.operators.ranks import ranked, running, share_step
from statera.scratch import table

RATE, STEPS, PLATT_STEPS, PENALTY = 0.5, 500, 2000, 1e-3
#: Different feature vectors of a family that one task holds; they are few, since signals are flags.
MOST_VECTORS = 200_000
GRID = 41
SIGNALS = ("self_consistency", "det_llm_agreement", "validator_pass", "grammar_match", "footing_ok")


def encode(signals: str = "") -> Column:
    """17 features: presence and value of five signals, the suspect flag, ambiguity, and the route."""
    col = lambda n: F.col(f"{signals}{n}")
    pairs = [x for n in SIGNALS for x in (F.when(col(n).isNull(), 0.0).otherwise(1.0), F.coalesce(col(n).cast("double"), F.lit(0.0)))]
    routes = [F.when(col("route") == r, 1.0).otherwise(0.0) for r in ROUTES]
    return F.array(*pairs, F.when(col("suspect"), 1.0).otherwise(0.0), F.coalesce(col("char_ambiguity").cast("double"), F.lit(0.0)), *routes)


def logistic(x: np.ndarray, right: np.ndarray, steps: int = STEPS, n: np.ndarray | None = None) -> np.ndarray:
    """Gradient steps from zero on the mean log loss with an L2 penalty; the first column of x is the intercept, penalised too. A row
    of x stands for n rows (1 each where n isn't given), of which right are correct."""
    n = np.ones(len(right)) if n is None else n
    return _descent(lambda w: _pull(x, right, n, w), x.shape[1], n.sum(), steps)


def _pull(x: np.ndarray, right: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient of the summed log loss at w; those of several parts of the rows add up."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
    return x.T @ (n * p - right)


def _descent(pull: Callable[[np.ndarray], np.ndarray], width: int, total: float, steps: int) -> np.ndarray:
    w = np.zeros(width)
    for _ in range(steps):
        w -= RATE * (pull(w) / total + PENALTY * w)
    return w


def guarded(samples: DataFrame, split: str) -> DataFrame:
    """samples, failing at the first row of another split."""
    why = F.concat(F.lit(f"expected only {split} rows, found "), F.coalesce("split", F.lit("none")))
    return samples.withColumn("split", F.when(F.col("split") == split, F.col("split")).otherwise(F.raise_error(why).cast("string")))


def _vectors(samples: DataFrame, by: str, split: str, most: int | None = None) -> DataFrame:
    """family, by, n, right: the distinct values of by with their counts. With most, which no fit gives, about that many a family."""
    vectors = guarded(samples, split).groupBy("family", by, "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("right"))
    if most is None:
        return vectors
    share = F.lit(1e6 * most) / F.count(F.lit(1))
    bars = vectors.groupBy("family").agg(share.alias("bar"))
    return vectors.join(F.broadcast(bars), "family").filter(F.pmod(F.xxhash64(by), F.lit(1_000_000)) < F.col("bar")).drop("bar")  # one row a family


def _fitted(vectors: DataFrame, by: str, design: Callable[[list], np.ndarray], steps: int, most: int) -> DataFrame:
    """family, weights from all of the vectors (family, by, n, right); design makes the columns of x from values of by.

    A family with at most `most` vectors is fitted in one task. A larger one is dealt out in parts of that size, and each step adds up the
    gradients of the parts, so no task and no row holds more than a part; it takes a job a step.
    """
    spark, counted = vectors.sparkSession, table(vectors.filter("family IS NOT NULL"), "vectors")
    sizes = {r["family"]: r["count"] for r in counted.groupBy("family").count().filter(F.col("count") > most).collect()}  # one row a family

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = logistic(design(list(pdf[by])), pdf["right"].to_numpy(float), steps, pdf["n"].to_numpy(float))
        return pd.DataFrame({"family": [pdf["family"].iloc[0]], "weights": [w.tolist()]})

    def part(rows):
        held = [(r[by], r["right"], r["n"]) for r in rows]
        if held:
            values, right, n = zip(*held, strict=True)
            yield design(list(values)), np.array(right, float), np.array(n, float)

    out = counted.filter(~F.col("family").isin(*sizes)).groupBy("family").applyInPandas(run, "family string, weights array<double>")
    for family, size in sorted(sizes.items()):
        rows = counted.filter(F.col("family") == family).select(by, "right", "n").repartition(math.ceil(size / most))
        parts = rows.rdd.mapPartitions(part).persist(StorageLevel.MEMORY_AND_DISK)
        width, total = parts.map(lambda x: x[0].shape[1]).first(), parts.map(lambda x: x[2].sum()).sum()
        w = _descent(lambda w: parts.map(lambda x: _pull(*x, w)).reduce(add), width, total, steps)  # noqa: B023
        parts.unpersist()
        out = out.unionByName(spark.createDataFrame([(family, w.tolist())], "family string, weights array<double>"))
    return out


def fit(samples: DataFrame, steps: int = STEPS, most: int = MOST_VECTORS) -> DataFrame:
    """family, weights (intercept first) from train rows (family, features, correct, split). Other splits raise.

    Rows alike in features become one row with a weight, which gives the same gradient. Every vector counts; one task holds at most `most`.
    """
    design = lambda values: np.column_stack([np.ones(len(values)), np.stack(values)])
    return _fitted(_vectors(samples, "features", "train"), "features", design, steps, most)


def score(rows: DataFrame, models: DataFrame) -> DataFrame:
    """confidence of rows (family, features): native dot product and sigmoid; a family without a model gets 0."""
    out = rows.join(F.broadcast(models), "family", "left")  # one row a family
    dot = F.aggregate(F.zip_with(F.concat(F.array(F.lit(1.0)), "features"), "weights", lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
    return out.withColumn("confidence", F.when(F.col("weights").isNull(), 0.0).otherwise(S.sigmoid(dot))).drop("weights")


def fit_platt(samples: DataFrame, most: int = MOST_VECTORS) -> DataFrame:
    """family, slope, intercept of confidence on the logit scale, from calibration rows; alike confidences become one weighted row, as in fit."""

    def design(values: list) -> np.ndarray:
        c = np.array(values, float)
        with np.errstate(divide="ignore"):
            return np.column_stack([np.ones(len(c)), np.clip(np.log(c) - np.log1p(-c), -40, 40)])

    out = _fitted(_vectors(samples, "confidence", "calibration"), "confidence", design, PLATT_STEPS, most)
    return out.select("family", F.col("weights")[1].alias("slope"), F.col("weights")[0].alias("intercept"))


def rescale(rows: DataFrame, scalers: DataFrame) -> DataFrame:
    out = rows.join(F.broadcast(scalers), "family", "left")  # one row a family
    scaled = S.sigmoid(F.col("slope") * S.logit("confidence") + F.col("intercept"))
    return out.withColumn("confidence", F.when(F.col("slope").isNull(), F.col("confidence")).otherwise(scaled)).drop("slope", "intercept")


def _counted(samples: DataFrame) -> DataFrame:
    return samples.groupBy("family", F.col("confidence").alias("threshold")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("correct").cast("int")).alias("r"))


def _from_above(counts: DataFrame) -> DataFrame:
    """family, threshold, n, accepted, right of counts (family, threshold, c, r): what is at or above each threshold, summed by steps of the
    confidence, so a family with as many confidences as rows isn't ordered in one task."""
    down = running(counts, ["family"], [F.desc("threshold")], share_step(F.col("threshold")), {"c": "accepted", "r": "right"}, "n", down=True)
    return down.select("family", "threshold", "n", "accepted", "right")


def sweep(samples: DataFrame) -> DataFrame:
    """family, threshold, n, accepted, right: for every distinct confidence as a threshold."""
    return _from_above(_counted(samples))


def choose_thresholds(samples: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """family, threshold, accepted, right, n: the most accepted at or above the family's precision; else nothing accepted, threshold NULL."""
    target = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    good = F.col("right") / F.col("accepted") >= F.try_element_at(target, F.col("family"))
    best = F.max_by(F.struct("threshold", "accepted", "right"), F.when(good, F.col("accepted")))  # rows that fall short are passed over
    out = sweep(samples).groupBy("family").agg(F.max("n").alias("n"), best.alias("b"))
    return out.select("family", "b.threshold", F.coalesce("b.accepted", F.lit(0)).alias("accepted"), F.coalesce("b.right", F.lit(0)).alias("right"), "n")


def _at_thresholds(samples: DataFrame, points: DataFrame) -> DataFrame:
    """points (family, threshold, ...) with n, accepted, right: counts of the samples at or above. One union in order of value and
    running sums over the distinct values, so samples are never paired with points."""
    asked = points.select("family", "threshold").distinct().withColumns({"c": F.lit(0).cast("bigint"), "r": F.lit(0).cast("bigint")})
    sums = _counted(samples).unionByName(asked).groupBy("family", "threshold").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    return points.join(_from_above(sums), ["family", "threshold"])


def grid(families: DataFrame, points: int = GRID) -> DataFrame:
    """family, threshold: an even grid from 0 to 1."""
    return families.select("family", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select("family", (F.col("i") / (points - 1)).alias("threshold"))


def sweep_curve(calibration: DataFrame, reported: DataFrame, applied: DataFrame, points: int = GRID) -> DataFrame:
    """family, ordinal, threshold, n, accepted, right, precision, review_rate: the published layout of a sweep.

    First the curve on the calibration samples, the grid and the applied threshold in rising order, without the points that accept nothing
    unless one is the applied point; last the point achieved on the reported samples. applied: family, threshold, one row a family.
    """
    applied = applied.filter("threshold IS NOT NULL").select("family", "threshold")
    asked = grid(applied, points).unionByName(applied).distinct()
    curve = _at_thresholds(calibration, asked).join(applied.withColumn("applied", F.lit(True)), ["family", "threshold"], "left")
    curve = curve.filter("accepted > 0 OR applied").drop("applied").withColumn("last", F.lit(0))
    achieved = _at_thresholds(reported, applied).withColumn("last", F.lit(1))
    both = curve.unionByName(achieved).withColumn("precision", F.when(F.col("accepted") == 0, 1.0).otherwise(F.try_divide("right", "accepted")))
    both = both.withColumn("review_rate", 1 - F.col("accepted") / F.col("n"))
    order = Window.partitionBy("family").orderBy("last", "threshold")  # GRID + 2 rows a family
    return both.withColumn("ordinal", F.row_number().over(order) - 1).drop("last")


def recovered_sweeps(points: DataFrame) -> DataFrame:
    """family, applied, achieved (points) and curve_points of a published sweep. The last point is the achieved one and its threshold must
    be on the curve, else the job fails: such a tuple would mark a result that nothing measured."""
    point = F.struct("threshold", "n", "accepted", "right")
    last = points.groupBy("family").agg(F.max("ordinal").alias("last"), F.max_by(point, "ordinal").alias("achieved"))
    curve = points.join(F.broadcast(last), "family").filter("ordinal < last")  # one row a family
    found = curve.groupBy("family").agg(F.first("achieved").alias("achieved"), F.count(F.lit(1)).alias("curve_points"), F.max(F.when(F.col("threshold") == F.col("achieved.threshold"), point)).alias("applied"))
    out = last.select("family", F.col("achieved").alias("_a")).join(found, "family", "left")
    wrong = F.raise_error(F.concat(F.col("family"), F.lit(" reports a result at a threshold that is no point of its curve")))
    return out.select("family", F.when(F.col("applied").isNull(), wrong.cast(found.schema["applied"].dataType)).otherwise(F.col("applied")).alias("applied"), F.col("_a").alias("achieved"), "curve_points")


def reliability(samples: DataFrame, bins: int = 10) -> DataFrame:
    """family, bin, n, mean_confidence, right: bins of equal count in order of confidence, then of the digest of field_id."""
    rows = ranked(samples, ["family"], F.col("field_id"), [F.col("confidence")], share_step(F.col("confidence"))).withColumnRenamed("n", "n_all")
    rows = rows.withColumn("bin", F.expr(f"CAST(({bins} * rn - 1) DIV n_all AS INT)"))
    return rows.groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.sum(F.col("correct").cast("int")).alias("right"))


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_confidence") - F.col("right") / F.col("n"))
    return bins.groupBy("family").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def headline(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = samples.join(F.broadcast(thresholds.select("family", "threshold")), "family")  # one row a family
    taken = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(taken).alias("accepted"), F.count_if(taken & F.col("correct")).alias("right"))
