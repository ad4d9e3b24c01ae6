"""Segmentation losses over a long batch ``(b, c, px, pred, target)``: image, class, pixel, score, one-hot target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-7


def soft_dice(overlap: Column, size: Column, smooth: float = 0.0, eps: float = TINY) -> Column:
    """(2 * overlap + smooth) / max(size + smooth, eps), of sums over whatever is reduced."""
    return (2 * overlap + smooth) / F.greatest(size + F.lit(float(smooth)), F.lit(eps))


def probabilities(batch: DataFrame, mode: str = "multiclass") -> DataFrame:
    """``pred`` from logits: softmax over the classes of a pixel, or the logistic function in binary mode."""
    if mode == "binary":
        return batch.withColumn("pred", 1 / (1 + F.exp(-F.col("pred"))))
    if mode != "multiclass":
        raise ValueError("mode must be 'multiclass' or 'binary'")
    pixel = Window.partitionBy("b", "px")
    e = batch.withColumn("~e", F.exp(F.col("pred") - F.max("pred").over(pixel)))
    return e.withColumn("pred", F.col("~e") / F.sum("~e").over(pixel)).drop("~e")


def dice_loss(batch: DataFrame, mode: str = "multiclass", classes: list[int] | None = None, log_loss: bool = False, from_logits: bool = True, smooth: float = 0.0, eps: float = TINY, ignore_index: int | None = None) -> DataFrame:
    """One row ``loss``: 1 - dice (or -log dice) of each class over all images and pixels; a class without targets counts 0 in the mean.

    ``ignore_index`` masks predictions where the target has that value, and leaves the targets. ``classes`` picks classes.
    """
    own = probabilities(batch, mode) if from_logits else batch
    if ignore_index is not None:
        own = own.withColumn("pred", F.when(F.col("target") == ignore_index, 0.0).otherwise(F.col("pred")))
    sums = own.groupBy("c").agg(F.sum(F.col("pred") * F.col("target")).alias("o"), F.sum(F.col("pred") + F.col("target")).alias("s"), F.sum("target").alias("t"))
    score = soft_dice(F.col("o"), F.col("s"), smooth, eps)
    each = -F.log(F.greatest(score, F.lit(eps))) if log_loss else 1 - score
    if classes is not None:
        sums = sums.where(F.col("c").isin(classes))
    return sums.agg(F.avg(F.when(F.col("t") > 0, each).otherwise(0.0)).alias("loss"))


def focal_loss(batch: DataFrame, mode: str = "multiclass", alpha: list[float] | float | None = None, normalize_weights: bool = True, gamma: float = 2.0, from_logits: bool = True, ignore_index: int | None = None) -> DataFrame:
    """One row ``loss``: the mean over pixels of alpha_t (1 - p_t)^gamma (-log max(p_t, TINY)), of the target class.

    The target class is the one with the greatest target, the first of ties. In multiclass mode alpha defaults to 1 /
    classes, and given weights are normalised to sum to 1 unless told otherwise. In binary mode the single channel's p_t is
    that of its target, 0 or 1, which the arg-max over one channel makes 0 always; this is kept. There alpha is one number
    a, which weighs a target of 1 by a and of 0 by 1 - a; every pixel weighs 1 without it.
    """
    if mode == "binary" and alpha is not None:
        alpha = [alpha] if isinstance(alpha, int | float) else list(alpha)
        if len(alpha) != 1:
            raise ValueError("in binary mode alpha is one number")
        if normalize_weights:
            alpha = [1.0]  # a weight over its own sum
    own = probabilities(batch, mode) if from_logits else batch
    n = own.agg(F.countDistinct("c").alias("n"))
    target = own.groupBy("b", "px").agg(F.max_by("c", F.struct("target", -F.col("c"))).alias("t"))
    if mode == "binary":
        at = own.join(target, ["b", "px"]).withColumn("pt", F.when(F.col("t") == 1, F.col("pred")).otherwise(1 - F.col("pred")))
    else:
        at = own.join(target, ["b", "px"]).where(F.col("c") == F.col("t")).withColumn("pt", F.col("pred"))
    if ignore_index is not None:
        at = at.where(F.col("t") != ignore_index)
    if mode == "binary":
        weight = F.lit(1.0) if alpha is None else F.when(F.col("t") == 1, float(alpha[0])).otherwise(1.0 - float(alpha[0]))
        at = at.withColumn("alpha", weight)
    elif alpha is None:
        at = at.crossJoin(F.broadcast(n)).withColumn("alpha", 1.0 / F.col("n"))
    else:
        whole = sum(alpha) if normalize_weights else 1.0
        weights = F.array(*(F.lit(float(a) / whole) for a in alpha))
        at = at.withColumn("alpha", F.get(weights, F.col("t").cast("int")))
    term = F.col("alpha") * F.pow(1 - F.col("pt"), F.lit(float(gamma))) * -F.log(F.greatest(F.col("pt"), F.lit(TINY)))
    return at.agg(F.avg(term).alias("loss"))


def hybrid_loss(batch: DataFrame, focal_weight: float = 0.5, dice_weight: float = 0.5, **settings: object) -> DataFrame:
    """One row ``loss``: the weighted sum of both losses; the weights must add up to 1. Settings of the focal part only: alpha, gamma, normalize_weights, ignore_index."""
    if abs(focal_weight + dice_weight - 1.0) > 1e-12:
        raise ValueError("the weights must add up to 1")
    shared = {k: v for k, v in settings.items() if k in ("mode", "from_logits")}
    dice = {k: v for k, v in settings.items() if k in ("classes", "log_loss", "smooth", "eps")}
    focal = {k: v for k, v in settings.items() if k in ("alpha", "gamma", "normalize_weights", "ignore_index")}
    f = focal_loss(batch, **shared, **focal).withColumnRenamed("loss", "f")
    d = dice_loss(batch, **shared, **dice).withColumnRenamed("loss", "d")
    return f.crossJoin(d).select((focal_weight * F.col("f") + dice_weight * F.col("d")).alias("loss"))
