"""Holdouts, walk-forward folds, weights, learners per fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastframe.operators.windows import before


def holdout_latest_dates(df: DataFrame, date: str, frac: float | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(development, test): whole dates from the end until the test part has n rows, or the share frac of all."""
    days = df.groupBy(F.to_date(date).alias("__day")).agg(F.count("*").alias("c"))
    w = Window.orderBy(F.col("__day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    want = F.lit(n) if n is not None else F.ceil(F.sum("c").over(Window.partitionBy(F.lit(0))) * frac)
    test = days.select("__day", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("later"), want.alias("want")).where("later < want").select("__day")
    marked = df.withColumn("__day", F.to_date(date))
    return marked.join(F.broadcast(test), "__day", "left_anti").drop("__day"), marked.join(F.broadcast(test), "__day", "left_semi").drop("__day")  # dates, not rows


@dataclass(frozen=True)
class FoldSpec:
    """Test windows of test_rows rows or more (whole dates), train_rows before each; from the last n_seasons before the end."""

    folds: int = 5
    test_rows: int = 100
    train_rows: int = 1000
    min_train: int = 100
    excluded_months: tuple[int, ...] = ()
    pick: str = "latest"  # latest, earliest or even


def fold_bounds(days: list[tuple[object, int]], spec: FoldSpec) -> list[dict]:
    """The folds' bounds from (date, rows) in order: greedy, as the next window begins after the last accepted one."""
    cum, total = [], 0
    for _, n in days:
        cum.append(total)
        total += n
    out, i = [], 0
    while i < len(days):
        if days[i][0].month in spec.excluded_months:
            i += 1
            continue
        j, rows = i, 0
        while j < len(days) and rows < spec.test_rows and days[j][0].month not in spec.excluded_months:
            rows += days[j][1]
            j += 1
        if rows >= spec.test_rows and min(cum[i], spec.train_rows) >= spec.min_train:
            out.append({"test_start": days[i][0], "test_end": days[j - 1][0], "first": max(0, cum[i] - spec.train_rows), "end": cum[i]})
            i = j
        else:
            i += 1
    if len(out) > spec.folds:
        at = range(len(out) - spec.folds, len(out)) if spec.pick == "latest" else range(spec.folds) if spec.pick == "earliest" else np.linspace(0, len(out) - 1, spec.folds).round().astype(int)
        out = [out[k] for k in at]
    return [{"fold": k, **f} for k, f in enumerate(out)]


def positions(df: DataFrame, date: str, tie: str) -> DataFrame:
    """df with __day and __pos, a row's place from 0 in (date, tie) order: its rank within the date and the rows of earlier dates."""
    day = df.groupBy(F.to_date(date).alias("__day")).agg(F.count("*").alias("__n"))
    offset = day.select("__day", F.coalesce(F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))  # one row per date
    return df.withColumn("__day", F.to_date(date)).join(offset, "__day").withColumn("__pos", F.col("__off") + F.row_number().over(Window.partitionBy("__day").orderBy(tie)) - 1).drop("__off")


def walk_forward_folds(df: DataFrame, date: str, tie: str, spec: FoldSpec = FoldSpec()) -> DataFrame:
    """(fold, tie, role): test rows by date, training rows the train_rows before the first test date in (date, tie) order.

    The driver sees counts per date only. Row positions are ranks within a date plus the rows of earlier dates, so no
    window runs over all rows; bounds are a handful and are broadcast.
    """
    counts = df.groupBy(F.to_date(date).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    bounds = fold_bounds([(r.d, r.n) for r in counts], spec)
    spark = df.sparkSession
    schema = "fold int, test_start date, test_end date, first long, end long"
    b = spark.createDataFrame([(f["fold"], f["test_start"], f["test_end"], f["first"], f["end"]) for f in bounds], schema)
    pos = positions(df.select(tie, date), date, tie)
    role = F.when(F.col("__day").between(F.col("test_start"), F.col("test_end")), "test").when((F.col("__pos") >= F.col("first")) & (F.col("__pos") < F.col("end")), "train")
    return pos.join(F.broadcast(b), ((F.col("__day") <= F.col("test_end")) & (F.col("__pos") >= F.col("first")))).select("fold", tie, F.col("__day").alias("date"), role.alias("role")).where("role is not null")


def validate_folds(folds: DataFrame, key: str) -> DataFrame:
    """Per fold: sizes, bounds, and whether training ends before the test and no row is in both."""
    g = folds.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"), F.max(F.when(F.col("role") == "train", F.col("date"))).alias("train_end"), F.min(F.when(F.col("role") == "test", F.col("date"))).alias("test_start"), F.max(F.when(F.col("role") == "test", F.col("date"))).alias("test_end"))
    both = folds.groupBy("fold", key).agg(F.count_distinct("role").alias("r")).where("r > 1").groupBy("fold").agg(F.count("*").alias("n_overlap"))
    ok = (F.col("n_train") > 0) & (F.col("n_test") > 0) & (F.col("train_end") < F.col("test_start")) & (F.col("n_overlap") == 0)
    return g.join(both, "fold", "left").fillna(0, ["n_overlap"]).withColumn("valid", F.coalesce(ok, F.lit(False)))


def summarize_folds(folds: DataFrame) -> DataFrame:
    """Size and bounds of each fold's parts."""
    return folds.groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def recency_weights(df: DataFrame, date: str, lam: float, fold: str | None = None) -> DataFrame:
    """exp(-lam * days before the newest row of the fold)."""
    newest = df.groupBy(*([fold] if fold else [])).agg(F.max(date).alias("__new"))
    got = df.join(F.broadcast(newest), fold) if fold else df.crossJoin(F.broadcast(newest))  # one row per fold
    return got.withColumn("weight", F.exp(-lam * F.datediff("__new", date))).drop("__new")


Learner = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


@dataclass(frozen=True)
class Ridge:
    """A learner: ridge regression with an intercept; nulls count as the training mean. Folds of it are solved from sums of products (fold_models)."""

    features: tuple[str, ...]
    target: str
    penalty: float = 1.0
    weight: str | None = None

    def __call__(self, train: pd.DataFrame, test: pd.DataFrame) -> np.ndarray:
        names = list(self.features)
        mean = train[names].mean().fillna(0.0)
        x, y = train[names].fillna(mean).to_numpy(float), train[self.target].to_numpy(float)
        w = train[self.weight].to_numpy(float) if self.weight else np.ones(len(y))
        a = np.column_stack([np.ones(len(x)), x])
        reg = self.penalty * np.eye(a.shape[1])
        reg[0, 0] = 0
        beta = np.linalg.lstsq(a.T @ (a * w[:, None]) + reg, a.T @ (w * y), rcond=None)[0]
        return np.column_stack([np.ones(len(test)), test[names].fillna(mean).to_numpy(float)]) @ beta


def ridge(features: list[str], target: str, penalty: float = 1.0, weight: str | None = None) -> Ridge:
    return Ridge(tuple(features), target, penalty, weight)


def gram_sums(df: DataFrame, group: str, model: Ridge, center: list[float]) -> DataFrame:
    """(group, gram, plain): per group the sums of products that a ridge regression over its rows needs, as matrices.

    A row is (1, features less their center, which are null, target less its center); gram sums its weighted products with
    itself, plain its values. Rows without a target don't count. A task adds up its rows by group and sends a matrix a
    group: what is sent doesn't grow with the rows, and however many of them are of one group.
    """
    cols = [*model.features, model.target]
    x = df.where(F.col(model.target).isNotNull()).select(group, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], (F.col(model.weight).cast("double") if model.weight else F.lit(1.0)).alias("w"))
    kind, wide = dict(df.dtypes)[group], 2 * len(cols)

    def partial(frames):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in frames:
            for g, part in pdf.groupby(group):
                v = part[[f"c{i}" for i in range(len(cols))]].to_numpy(float) - center
                none = np.isnan(v[:, :-1])
                z = np.column_stack([np.ones(len(v)), np.where(none, 0.0, v[:, :-1]), none, v[:, -1]])
                gram, plain = sums.get(g, (np.zeros((wide, wide)), np.zeros(wide)))
                sums[g] = gram + z.T @ (z * part.w.to_numpy()[:, None]), plain + z.sum(0)
        yield pd.DataFrame([(g, m.tobytes(), u.tobytes()) for g, (m, u) in sums.items()], columns=[group, "gram", "plain"])

    return x.mapInPandas(partial, f"{group} {kind}, gram binary, plain binary")


def fold_models(grams: DataFrame, model: Ridge, penalties: list[float], center: list[float]) -> DataFrame:
    """(fold, penalty, b0, beta, fill) of grams (fold, gram, plain), whose matrices are added up by fold and solved for every penalty."""
    p = len(model.features)

    def solve(key, pdf):
        gram = sum(np.frombuffer(m).reshape(2 * p + 2, -1) for m in pdf.gram)
        plain = sum(np.frombuffer(u) for u in pdf.plain)
        there = plain[0] - plain[1 + p : 1 + 2 * p]
        mean = np.where(there > 0, plain[1 : 1 + p] / np.maximum(there, 1), -np.array(center[:-1]))
        s = np.zeros((2 * p + 2, p + 1))
        s[0, 0] = 1
        s[1 + np.arange(p), 1 + np.arange(p)] = 1
        s[1 + p + np.arange(p), 1 + np.arange(p)] = mean
        reg = np.eye(p + 1)
        reg[0, 0] = 0
        rows = []
        for penalty in penalties:
            beta = np.linalg.lstsq(s.T @ gram @ s + penalty * reg, s.T @ gram[:, -1], rcond=None)[0]
            rows.append((key[0], penalty, beta[0] + center[-1], beta[1:].tolist(), mean.tolist()))
        return pd.DataFrame(rows, columns=["fold", "penalty", "b0", "beta", "fill"])

    return grams.groupBy("fold").applyInPandas(solve, "fold int, penalty double, b0 double, beta array<double>, fill array<double>")


def ridge_predictions(test: DataFrame, models: DataFrame, model: Ridge, center: list[float], keep: list[str]) -> DataFrame:
    """keep and prediction of test (fold, features, ...) by its fold's model."""
    terms = [F.coalesce(F.col(c).cast("double") - m, F.get("fill", F.lit(j))) * F.get("beta", F.lit(j)) for j, (c, m) in enumerate(zip(model.features, center[:-1], strict=True))]
    return test.join(F.broadcast(models), "fold").select(*keep, reduce(Column.__add__, terms, F.col("b0")).alias("prediction"))  # a model a fold and penalty


def centers(df: DataFrame, model: Ridge) -> list[float]:
    """Means of features and target: products are taken from there, so that sums don't cancel."""
    return [m or 0.0 for m in df.agg(*[F.avg(F.col(c).cast("double")) for c in (*model.features, model.target)]).first()]


def ridge_folds(df: DataFrame, folds: DataFrame, key: str, model: Ridge, penalties: list[float]) -> DataFrame:
    """(fold, penalty, key, prediction) of each fold's test rows: one solved system a fold and penalty, from one pass over the training rows."""
    data = folds.select("fold", key, "role").join(df, key)
    center = centers(df, model)
    models = fold_models(gram_sums(data.where("role = 'train'"), "fold", model, center), model, penalties, center)
    return ridge_predictions(data.where("role = 'test'"), models, model, center, ["fold", "penalty", key])


def ridge_walk_forward(df: DataFrame, date: str, key: str, model: Ridge, spec: FoldSpec) -> DataFrame:
    """(fold, key, prediction) of walk_forward_folds by a ridge regression retrained for each, from one pass over the rows.

    Windows overlap, so their bounds cut the rows' positions into segments; every row is summed into its segment once, and
    a window is the sum of its segments' matrices. Rows meet no fold but the one that tests them.
    """
    counts = df.groupBy(F.to_date(date).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    bounds = fold_bounds([(r.d, r.n) for r in counts], spec)
    if not bounds:
        return df.select(F.lit(0).alias("fold"), key, F.lit(None).cast("double").alias("prediction")).limit(0)
    cuts = sorted({f[c] for f in bounds for c in ("first", "end")})
    at = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("__pos")))
    placed = positions(df, date, key).withColumn("segment", at)
    center = centers(df, model)
    used = df.sparkSession.createDataFrame([(f["fold"], k) for f in bounds for k in range(cuts.index(f["first"]) + 1, cuts.index(f["end"]) + 1)], "fold int, segment int")
    sums = gram_sums(placed.where((F.col("segment") > 0) & (F.col("segment") < len(cuts))), "segment", model, center)
    models = fold_models(sums.join(F.broadcast(used), "segment").drop("segment"), model, [model.penalty], center)  # folds and the segments between their bounds
    tests = df.sparkSession.createDataFrame([(f["fold"], f["test_start"], f["test_end"]) for f in bounds], "fold int, test_start date, test_end date")
    test = df.withColumn("__day", F.to_date(date)).join(F.broadcast(tests), F.col("__day").between(F.col("test_start"), F.col("test_end")))  # a row a fold
    return ridge_predictions(test, models, model, center, ["fold", key])


def score_folds(df: DataFrame, folds: DataFrame, key: str, learner: Learner, extra: DataFrame | None = None) -> DataFrame:
    """V2: predictions of each fold's test rows by a learner that sees its training rows only: (fold, key, prediction).

    A fold's rows are bounded by its spec; folds run side by side. extra: a short grid of parameters, each row of which
    scores every fold (E24); it goes to the folds, not the folds' rows to it. The learner finds them as constant columns.
    A ridge regression is solved from sums of products instead, and no fold is gathered anywhere.
    """
    if isinstance(learner, Ridge) and extra is None:
        return ridge_folds(df, folds, key, learner, [learner.penalty]).drop("penalty")
    data = folds.select("fold", key, "role").join(df, key)
    grid = extra.toPandas().to_dict("records") if extra is not None else [{}]
    kinds = {**dict(data.dtypes), **(dict(extra.dtypes) if extra is not None else {})}
    keys = ["fold", *(extra.columns if extra is not None else [])]
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, key]) + ", prediction double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        train, test = pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        if not len(train) or not len(test) or not grid:
            return pd.DataFrame({c: [] for c in [*keys, key, "prediction"]})
        return pd.concat([test.assign(**p, prediction=learner(train.assign(**p), test.assign(**p)))[[*keys, key, "prediction"]] for p in grid])

    return data.groupBy("fold").applyInPandas(one, schema)


def walk_forward_score(df: DataFrame, date: str, key: str, learner: Learner, days: int, max_rows: int) -> DataFrame:
    """E5: each of the last `days` dates scored from the max_rows rows before it. A ridge regression takes one pass over the rows, any other learner the rows of every window."""
    spec = FoldSpec(folds=days, test_rows=1, train_rows=max_rows, min_train=1)
    if isinstance(learner, Ridge):
        return ridge_walk_forward(df, date, key, learner, spec)
    if not df.take(1):
        return df.select(F.lit(0).alias("fold"), key, F.lit(None).cast("double").alias("prediction")).limit(0)
    return score_folds(df, walk_forward_folds(df, date, key, spec), key, learner)


def grid_over_folds(df: DataFrame, folds: DataFrame, grid: DataFrame, key: str, target: str, make: Callable[[pd.DataFrame], Learner]) -> DataFrame:
    """Mean absolute validation error of every parameter set over all folds. make(one row of parameters) gives the learner.

    Ridge regressions that differ in their penalty are all solved from the same sums of products of a fold.
    """
    rows = grid.toPandas()  # a short grid
    made = [make(r) for _, r in rows.iterrows()]
    if made and all(isinstance(m, Ridge) and replace(m, penalty=0.0) == replace(made[0], penalty=0.0) for m in made) and len({m.penalty for m in made}) == len(made):
        named = grid.sparkSession.createDataFrame(rows.assign(__penalty=[float(m.penalty) for m in made]))
        preds = ridge_folds(df, folds, key, made[0], [float(m.penalty) for m in made]).withColumnRenamed("penalty", "__penalty").join(F.broadcast(named), "__penalty")
        return _grid_errors(preds.join(df.select(key, target), key), grid.columns, target)

    def learner(train: pd.DataFrame, test: pd.DataFrame) -> np.ndarray:
        return make(train.iloc[0])(train, test)

    return _grid_errors(score_folds(df, folds, key, learner, grid).join(df.select(key, target), key), grid.columns, target)


def _grid_errors(preds: DataFrame, params: list[str], target: str) -> DataFrame:
    err = preds.groupBy(*params, "fold").agg(F.avg(F.abs(F.col("prediction") - F.col(target))).alias("mae"))
    return err.groupBy(*params).agg(F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"), F.count("*").alias("folds"))


def random_baseline(df: DataFrame, seed: int, key: str, out: str = "p_random") -> DataFrame:
    """A probability per row that follows from seed and key alone, so that it is the same on every run and layout."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13)
    return df.withColumn(out, F.conv(digits, 16, 10).cast("long") / float(1 << 52))


def historical_mean_baseline(df: DataFrame, value: str, season: str, out: str = "historical_mean") -> DataFrame:
    """The mean of the season before."""
    prev = df.groupBy((F.col(season) + 1).alias(season)).agg(F.avg(value).alias(out))
    return df.join(F.broadcast(prev), season, "left")  # one row per season


def rolling_apply(df: DataFrame, value: str, n: int, keys: list[str], order: list[str], fn: Callable[[Column], Column], out: str) -> DataFrame:
    """V1: any expression over the array of the last n non-null values before, oldest first."""
    got = df.withColumn("__v", F.collect_list(value).over(before(keys, order, n)))
    return got.withColumn(out, fn(F.col("__v"))).drop("__v")
