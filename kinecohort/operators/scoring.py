"""Folds, agreement metrics and the search for cut points and blend weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, threshold_label
from kinecohort.operators.order import POSITION, positioned
from kinecohort.operators.skew import HOT_ROWS, lookup_join

FOLDS = 5
MAX_LABELS = 1000


def stratified_folds(
    df: DataFrame,
    label: str,
    order: Sequence[str] = ("id",),
    folds: int = FOLDS,
    name: str = "fold",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Assign folds that keep the class shares, without shuffling.

    The classes, in order of first appearance, lie one after the other; position p of that
    line is dealt to fold p mod ``folds``, and the rows of a class fill their folds in row
    order. A class holds a large part of the table, so its rows are ranked by position in
    the sorted table and not by a window over the class.
    """
    positions = positioned(df, [label, *order])
    classes = positions.groupBy(col(label)).agg(
        F.min(POSITION).alias("_class_start"),
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(*[col(c) for c in order])).alias("_seen"),
    )
    # One row per class.
    line = Window.orderBy("_seen").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_from", F.coalesce(F.sum("_n").over(line), F.lit(0))).select(
        col(label), "_class_start", "_from", F.col("_n").alias("_to"), F.col("_n").alias("_weight")
    )
    joined = lookup_join(
        positions, classes, [label], "_weight", null_safe=True, hot_rows=hot_rows, spread_by=[POSITION]
    )
    rank = F.col(POSITION) - F.col("_class_start")
    first, after = F.col("_from"), F.col("_from") + F.col("_to")

    def dealt(i: int) -> Column:
        below = lambda p: F.floor((p - 1 - i) / F.lit(float(folds)))
        return below(after) - below(first)

    filled = [reduce(add, [dealt(j) for j in range(i + 1)]) for i in range(folds - 1)]
    fold = reduce(add, [(rank >= f).cast("int") for f in filled])
    return joined.select(*[col(c) for c in df.columns], fold.alias(name))


def accuracy(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[col(k) for k in by]).agg(
        F.avg((col(y) == col(p)).cast("double")).alias("accuracy")
    )


def confusion_matrix(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (true, predicted) label as ``y_true``, ``y_pred``, ``n``."""
    return df.groupBy(*[col(k) for k in by], col(y).alias("y_true"), col(p).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def quadratic_kappa(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), name: str = "kappa"
) -> DataFrame:
    """Quadratic weighted kappa per group, from the counts per label pair.

    Labels weigh by their place among the labels that occur, not by their value. A single
    label throughout gives NaN. More than MAX_LABELS distinct values are an error: those are
    scores, not labels, and their pairs would meet in one task.
    """
    cells = confusion_matrix(df, y, p, by)
    # Counted before any pair is gathered; a sketch, since the limit is far above any scale.
    kinds = [F.approx_count_distinct(c).alias(f"_{c}") for c in ("y_true", "y_pred")]
    distinct = cells.agg(*kinds).select(F.greatest("_y_true", "_y_pred")).scalar()
    checked = F.when(distinct > MAX_LABELS, F.raise_error(F.lit(f"more than {MAX_LABELS} labels")).cast("boolean")).otherwise(True)
    cells = cells.filter(checked)
    labels = F.array_sort(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")))
    grouped = cells.groupBy(*[col(k) for k in by]).agg(
        labels.alias("_labels"), F.collect_list(F.struct("y_true", "y_pred", "n")).alias("_cells")
    )

    def total(value) -> Column:
        def step(acc, c):
            a = F.array_position(F.col("_labels"), c["y_true"]) - 1
            b = F.array_position(F.col("_labels"), c["y_pred"]) - 1
            return acc + value(a, b) * c["n"]

        return F.aggregate("_cells", F.lit(0).cast("long"), step).cast("double")

    apart = total(lambda a, b: (a - b) * (a - b))
    size = total(lambda a, b: F.lit(1))
    squares = total(lambda a, b: a * a + b * b)
    chance = squares - 2 * total(lambda a, b: a) * total(lambda a, b: b) / size
    kappa = F.when(chance == 0, F.lit(float("nan"))).otherwise(1 - apart / F.nullif(chance, F.lit(0.0)))
    return grouped.select(*[col(k) for k in by], kappa.alias(name))


def cv_summary(oof: DataFrame, y: str = "y", p: str = "label", fold: str = "fold") -> DataFrame:
    """Mean and population deviation of the fold kappas, and the kappa of all rows together."""
    per_fold = quadratic_kappa(oof, y, p, [fold])
    whole = quadratic_kappa(oof, y, p, name="oof_kappa")
    return per_fold.agg(
        F.avg("kappa").alias("cv_mean_kappa"), F.stddev_pop("kappa").alias("cv_std_kappa")
    ).withColumn("oof_kappa", whole.scalar())


def score_against(labels: DataFrame, truth: DataFrame, target: str, id: str = "id") -> DataFrame:
    """Kappa, accuracy and rows of predicted labels (id, label) whose true value is known."""
    known = truth.select(col(id), col(target).cast("int").alias("y")).filter(F.col("y").isNotNull())
    both = labels.join(known, id)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("label")).cast("double")).alias("accuracy")
    ).withColumn("kappa", quadratic_kappa(both, "y", "label").scalar())


# --- cut points and blends ----------------------------------------------------


def cut_grid(low: float, high: float, step: float, also: Sequence[float] = ()) -> list[float]:
    """Candidate cut points, sorted; ``also`` are further ones (such as the start values)."""
    n = int(round((high - low) / step))
    return sorted({*(round(low + i * step, 10) for i in range(n + 1)), *map(float, also)})


def _cut_search(binned: DataFrame, cuts: Sequence[float], labels: int, key: Sequence[str]) -> DataFrame:
    """Best ascending cut points per candidate.

    ``binned`` holds ``y``, ``b`` (how many cut points are <= the score) and ``n`` per
    candidate: classes x bins numbers, whatever the row count. All combinations of cut
    points are generated from those and scored with plain arithmetic.
    """
    m, k = len(cuts), labels - 1
    cells = binned.groupBy(*[col(c) for c in key]).agg(F.collect_list(F.struct("y", "b", "n")).alias("_cells"))

    def upto(v: int) -> Column:
        own = F.filter("_cells", lambda c: c["y"] == v)
        return F.transform(
            F.sequence(F.lit(0), F.lit(m)),
            lambda i: F.aggregate(
                F.filter(own, lambda c: c["b"] <= i), F.lit(0).cast("long"), lambda acc, c: acc + c["n"]
            ),
        )

    state = cells.select(*[col(c) for c in key], *[upto(v).alias(f"_c{v}") for v in range(labels)])
    state = state.withColumn("_i0", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    state = state.repartition(*[col(c) for c in key], "_i0")
    for j in range(1, k):
        state = state.withColumn(f"_i{j}", F.explode(F.sequence(F.col(f"_i{j - 1}"), F.lit(m - 1))))

    def count(v: int, p: int) -> Column:
        upper = F.get(F.col(f"_c{v}"), F.lit(m) if p == k else F.col(f"_i{p}"))
        return upper - F.get(F.col(f"_c{v}"), F.col(f"_i{p - 1}")) if p else upper

    state = state.withColumns({f"_n{v}{p}": count(v, p) for v in range(labels) for p in range(labels)})
    n = {(v, p): F.col(f"_n{v}{p}") for v in range(labels) for p in range(labels)}
    of_true = [reduce(add, [n[v, p] for p in range(labels)]) for v in range(labels)]
    of_pred = [reduce(add, [n[v, p] for v in range(labels)]) for p in range(labels)]
    state = state.withColumns(
        {f"_t{v}": of_true[v] for v in range(labels)} | {f"_p{v}": of_pred[v] for v in range(labels)}
    )
    occurs = [((F.col(f"_t{v}") > 0) | (F.col(f"_p{v}") > 0)).cast("long") for v in range(labels)]
    place = {f"_l{v}": reduce(add, occurs[:v], F.lit(0).cast("long")) for v in range(labels)}
    state = state.withColumns(place)
    at = [F.col(f"_l{v}") for v in range(labels)]
    apart = reduce(add, [n[v, p] * (at[v] - at[p]) * (at[v] - at[p]) for v in range(labels) for p in range(labels) if v != p])
    margins = [(F.col(f"_t{v}"), F.col(f"_p{v}"), at[v]) for v in range(labels)]
    size = reduce(add, [t for t, _, _ in margins]).cast("double")
    squares = reduce(add, [(t + p) * a * a for t, p, a in margins]).cast("double")
    true_sum = reduce(add, [t * a for t, _, a in margins]).cast("double")
    pred_sum = reduce(add, [p * a for _, p, a in margins]).cast("double")
    chance = squares - 2 * true_sum * pred_sum / F.nullif(size, F.lit(0.0))
    kappa = F.when(chance != 0, 1 - apart.cast("double") / F.nullif(chance, F.lit(0.0)))
    # Among equal scores the lowest cut points win; an undefined score loses to any other.
    best = F.max(F.struct(kappa.alias("kappa"), *[(-F.col(f"_i{j}")).alias(f"i{j}") for j in range(k)]))
    cut_values = F.array(*[F.lit(float(c)) for c in cuts])
    found = state.groupBy(*[col(c) for c in key]).agg(best.alias("_best"))
    return found.select(
        *[col(c) for c in key],
        F.col("_best.kappa").alias("kappa"),
        *[F.get(cut_values, -F.col(f"_best.i{j}")).alias(f"t{j}") for j in range(k)],
    )


def _bin(score: Column, cuts: Sequence[float]) -> Column:
    """How many of the cut points are <= the score (NaN and null exceed all of them)."""
    above = reduce(add, [(score >= F.lit(float(c))).cast("int") for c in cuts])
    return F.coalesce(above, F.lit(len(cuts)))


def _on_scale(y: Column, labels: int) -> Column:
    """The label as an integer; null, a fraction, or one off the scale 0 .. labels-1 is an error."""
    whole = y.try_cast("int")
    good = (y.cast("double") == whole) & (whole >= 0) & (whole < labels)
    text = F.concat(F.lit(f"label off the scale 0..{labels - 1}: "), F.coalesce(y.cast("string"), F.lit("null")))
    return F.when(F.coalesce(good, F.lit(False)), whole).otherwise(F.raise_error(text).cast("int"))


def tune_thresholds(df: DataFrame, y: str, raw: str, cuts: Sequence[float], labels: int = 4) -> DataFrame:
    """Cut points among ``cuts`` with the highest kappa: one row (kappa, t0, t1, ...).

    Labels must lie on the scale 0 .. labels-1; any other, or a null one, is an error.
    """
    binned = df.groupBy(_on_scale(col(y), labels).alias("y"), _bin(col(raw), cuts).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _cut_search(binned.withColumn("_one", F.lit(0)), cuts, labels, ["_one"]).drop("_one")


def refine_thresholds(
    df: DataFrame,
    y: str,
    raw: str,
    start: Sequence[float],
    low: float,
    high: float,
    step: float = 0.1,
    rounds: int = 2,
) -> list[float]:
    """Cut points by a coarse grid and then ever finer ones around the best so far.

    The start values are among the candidates, so the result is never worse than them.
    """
    best = [float(t) for t in start]
    cuts = cut_grid(low, high, step, best)
    for _ in range(rounds):
        row = tune_thresholds(df, y, raw, cuts, len(start) + 1).first()
        if row is None or row["kappa"] is None:
            return best
        best = [row[f"t{j}"] for j in range(len(start))]
        around = {round(t + i * step / 5, 10) for t in best for i in range(-5, 6)}
        cuts, step = sorted(around | set(best)), step / 5
    return best


def blend_weights(members: int, candidates: int, seed: int) -> list[list[float]]:
    """Random weights that sum to 1 per candidate."""
    drawn = np.random.default_rng(seed).random((candidates, members))
    return (drawn / drawn.sum(axis=1, keepdims=True)).tolist()


def tune_blend(
    df: DataFrame,
    y: str,
    predictions: Sequence[str],
    weights: Sequence[Sequence[float]],
    cuts: Sequence[float],
    labels: int = 4,
) -> DataFrame:
    """Best cut points for every candidate of blend weights, one row per candidate.

    Each row is scored under all candidates, but counted at once map-side: the shuffle
    carries candidates x classes x bins numbers per task. A label off the scale is an error.
    """
    candidates = F.array(
        *[
            F.struct(F.lit(i).alias("i"), *[F.lit(float(w)).alias(f"w{j}") for j, w in enumerate(ws)])
            for i, ws in enumerate(weights)
        ]
    )
    each = df.select(_on_scale(col(y), labels).alias("y"), *[col(p) for p in predictions], F.explode(candidates).alias("c"))
    blended = reduce(add, [col(p) * F.col(f"c.w{j}") for j, p in enumerate(predictions)])
    binned = each.groupBy(F.col("c.i").alias("candidate"), "y", _bin(blended, cuts).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = _cut_search(binned, cuts, labels, ["candidate"])
    per_member = [
        F.get(F.array(*[F.lit(float(ws[j])) for ws in weights]), F.col("candidate")).alias(f"w{j}")
        for j in range(len(predictions))
    ]
    return best.select("candidate", *per_member, "kappa", *[f"t{j}" for j in range(labels - 1)])


def best_blend(tuned: DataFrame) -> DataFrame:
    return tuned.orderBy(F.desc("kappa"), "candidate").limit(1)


def labelled(df: DataFrame, raw: str, cuts: Sequence[float], name: str = "label") -> DataFrame:
    return df.withColumn(name, threshold_label(col(raw), cuts))
