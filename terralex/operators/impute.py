"""Filling missing values: chained regression, group medians, sparse columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.operators.quality import missing_profile
from terralex.operators.quantiles import global_row, medians_wide
from terralex.session import cut_lineage, ship_code


def sparse_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns missing in more than the threshold's share of rows (one row per column is fetched)."""
    rows = missing_profile(df, cols).filter(F.col("all_missing") | (F.col("missing_share") > threshold)).collect()
    found = {r["col"] for r in rows}
    return [c for c in cols if c in found]


def drop_sparse_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    return df.drop(*sparse_columns(df, cols, threshold))


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null becomes the exact column median."""
    med = F.col("_m")
    filled = {c: F.coalesce(F.col(c), med[c]) for c in cols}
    return df.withColumn("_m", global_row(medians_wide(df, [], cols))).withColumns(filled).drop("_m")


def group_median_impute(df: DataFrame, cols: Sequence[str], group: Sequence[str], medians: DataFrame | None = None) -> DataFrame:
    """Null becomes the group's median, else the given one-row medians (own ones by default), else 0."""
    own = medians_wide(df, group, cols).select(*group, *[F.col(c).alias(f"_g_{c}") for c in cols])
    whole = global_row(medians if medians is not None else medians_wide(df, [], cols))
    filled = {c: F.coalesce(F.col(c), F.col(f"_g_{c}"), F.col("_m")[c], F.lit(0.0)) for c in cols}
    joined = df.join(own, list(group), "left").withColumn("_m", whole)
    return joined.withColumns(filled).select(*df.columns)


# --- regression from moments -----------------------------------------------------------------


@dataclass
class Moments:
    """Centred second moments of some features and a label: all a linear fit needs."""

    n: float
    x_mean: np.ndarray
    y_mean: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float


def moments(df: DataFrame, features: Sequence[str], label: str, shift: dict[str, float] | None = None) -> Moments | None:
    """One aggregation over the table; the result has features² numbers whatever the table's size.

    Sums are taken around ``shift`` (rough means) to keep the centring accurate.
    """
    shift = shift or {}
    x = [F.col(f) - F.lit(float(shift.get(f, 0.0))) for f in features]
    y = F.col(label) - F.lit(float(shift.get(label, 0.0)))
    p = len(features)
    aggs: list[Column] = [F.count(F.lit(1)), F.sum(y), F.sum(y * y)]
    aggs += [F.sum(v) for v in x] + [F.sum(v * y) for v in x]
    aggs += [F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    n = float(row[0])
    if n == 0:
        return None
    values = np.array(row[1:], dtype=float)
    sy, syy, sx, sxy, upper = values[0], values[1], values[2 : 2 + p], values[2 + p : 2 + 2 * p], values[2 + 2 * p :]
    sxx = np.zeros((p, p))
    sxx[np.triu_indices(p)] = upper
    sxx = sxx + np.triu(sxx, 1).T
    base = np.array([shift.get(f, 0.0) for f in features])
    return Moments(
        n, sx / n + base, sy / n + shift.get(label, 0.0),
        sxx - np.outer(sx, sx) / n, sxy - sx * sy / n, max(syy - sy * sy / n, 0.0),
    )


def bayesian_ridge(m: Moments, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> tuple[np.ndarray, float]:
    """Ridge whose noise and weight precisions are set by evidence; returns weights and intercept."""
    eig, vec = np.linalg.eigh(m.xx)
    eig = np.maximum(eig, 0.0)
    turned = vec.T @ m.xy
    noise, weight = 1.0 / (m.yy / m.n + np.finfo(float).eps), 1.0
    solve = lambda: vec @ (turned / (eig + weight / noise))
    old = None
    for _ in range(rounds):
        coef = solve()
        if old is not None and np.abs(coef - old).sum() < tol:
            break
        old = coef
        residual = max(m.yy - 2 * coef @ m.xy + coef @ m.xx @ coef, 0.0)
        used = np.sum(noise * eig / (weight + noise * eig))
        weight = (used + 2 * prior) / (coef @ coef + 2 * prior)
        noise = (m.n - used + 2 * prior) / (residual + 2 * prior)
    coef = solve()
    return coef, float(m.y_mean - coef @ m.x_mean)


def ridge(m: Moments, alpha: float) -> tuple[np.ndarray, float]:
    coef = np.linalg.solve(m.xx + alpha * np.eye(len(m.xy)), m.xy)
    return coef, float(m.y_mean - coef @ m.x_mean)


def linear(cols: Sequence[str], coef: np.ndarray, intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, b in zip(cols, coef):
        out = out + F.col(c) * F.lit(float(b))
    return out


#: Numbers of a table of patterns that may come to the driver; beyond it the rounds run over the rows.
PATTERN_NUMBERS = 1 << 22


def _pattern(cols: Sequence[str], present: Sequence[str]) -> Column:
    """Bit i is set where the i-th column is missing; columns are cut into longs of 62 bits."""
    known = {c: F.col(c).isNull() if c in present else F.lit(True) for c in cols}
    words = []
    for at in range(0, len(cols), 62):
        bits = [F.when(known[c], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cols[at : at + 62])]
        words.append(sum(bits[1:], bits[0]))
    return F.array(*words)


def _missing(pattern: Sequence[int], n: int) -> np.ndarray:
    return np.array([bool(pattern[i // 62] >> (i % 62) & 1) for i in range(n)])


@dataclass
class ChainedImputer:
    """Means and the sequence of fitted regressions; applying it repeats the sequence.

    The sequence is affine, so all rows that miss the same columns get their values by one affine map of
    the columns they have: the maps are worked out once per pattern and joined to the rows, sent to all tasks
    if they hold at most ``PATTERN_NUMBERS`` numbers.
    """

    cols: list[str]
    means: dict[str, float]
    steps: list[tuple[str, list[str], list[float], float]] = field(default_factory=list)
    rounds: int = 0
    converged: bool = False

    def _start(self, df: DataFrame) -> DataFrame:
        known = {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in self.cols}
        flags = {f"_miss_{c}": known[c].isNull() for c in self.cols}
        out = df.withColumns(flags)
        return out.withColumns({c: F.coalesce(known[c], F.lit(self.means[c])) for c in self.cols})

    def maps(self, missing: np.ndarray) -> np.ndarray:
        """(patterns, columns, 1 + columns): each pattern's affine maps of the present columns' distances from the mean."""
        mean = np.array([self.means[c] for c in self.cols])
        out = first_maps(missing)
        place = {c: i for i, c in enumerate(self.cols)}
        for target, others, coef, intercept in self.steps:
            t, o = place[target], [place[c] for c in others]
            at = missing[:, t]
            out[at, t] = step_maps(out[at], o, np.array(coef), intercept + np.array(coef) @ mean[o] - mean[t])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        p = len(self.cols)
        if not p:
            return df
        patterned = df.withColumn("_pattern", _pattern(self.cols, df.columns))
        ship_code(df.sparkSession)

        def worked_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    found = self.maps(np.array([_missing(m, p) for m in batch["_pattern"]]))
                    yield pd.DataFrame({"_pattern": batch["_pattern"], "_maps": [m.ravel() for m in found]})

        maps = cut_lineage(patterned.select("_pattern").distinct().mapInPandas(worked_out, "_pattern array<bigint>, _maps array<double>"))
        if maps.count() * p * (p + 1) <= PATTERN_NUMBERS:
            maps = F.broadcast(maps)
        off = {c: F.coalesce(F.col(c).cast("double") - F.lit(self.means[c]), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in self.cols}
        filled = {}
        for i, c in enumerate(self.cols):
            weight = lambda j: F.col("_maps")[i * (p + 1) + j]  # noqa: B023, E731
            guess = sum((weight(j + 1) * off[o] for j, o in enumerate(self.cols)), weight(0) + F.lit(self.means[c]))
            filled[c] = F.coalesce(F.col(c).cast("double"), guess) if c in df.columns else guess
        return patterned.join(maps, "_pattern").withColumns(filled).drop("_pattern", "_maps")


def first_maps(missing: np.ndarray) -> np.ndarray:
    """Present columns stand for themselves, missing ones for their mean."""
    n, p = missing.shape
    out = np.zeros((n, p, p + 1))
    out[:, range(p), range(1, p + 1)] = ~missing
    return out


def step_maps(maps: np.ndarray, others: Sequence[int], coef: np.ndarray, constant: float) -> np.ndarray:
    """The maps of a column regressed on others."""
    out = np.einsum("o,noz->nz", coef, maps[:, others])
    out[:, 0] += constant
    return out


def fit_chained_imputer(df: DataFrame, cols: Sequence[str], max_rounds: int = 500, tol: float = 1e-3) -> ChainedImputer:
    """Round-robin regression of each incomplete column on all others, fewest missing first.

    Rounds stop when no filled value moves by more than ``tol`` of the largest absolute value; ``converged``
    says whether that came about. A column without any value is left out.

    Filled values are affine in a row's present columns, alike for all rows that miss the same columns. So
    the rows are read once for the moments of every such pattern, and the rounds run on these. Largest
    moves need the rows again: bounds from the moments leave a few rounds in doubt, which one more pass
    decides. A table of patterns above ``PATTERN_NUMBERS`` numbers stays in Spark, and every fit reads the rows.
    """
    cols = list(cols)
    filled = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    cols = [c for c in cols if filled[c]]
    if not cols:
        return ChainedImputer([], {}, converged=True)
    facts = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.sum(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in cols],
        F.max(F.greatest(F.lit(0.0), *[F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in cols])).alias("top"),
    ).first()
    model = ChainedImputer(cols, {c: float(facts[f"m_{c}"] or 0.0) for c in cols})
    todo = sorted((c for c in cols if facts[f"n_{c}"]), key=lambda c: (facts[f"n_{c}"], cols.index(c)))
    if not todo:
        model.converged = True
        return model
    limit = tol * float(facts["top"])
    off = [F.coalesce(F.col(c).cast("double") - F.lit(model.means[c]), F.lit(0.0)) for c in cols]
    p = len(cols)
    sums = [F.count(F.lit(1)), *map(F.sum, off), *[F.sum(off[i] * off[j]) for i in range(p) for j in range(i, p)], *[F.max(F.abs(o)) for o in off]]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], _pattern(cols, df.columns).alias("_pattern"))
    table = cut_lineage(rows.groupBy("_pattern").agg(F.array(*[s.cast("double") for s in sums]).alias("sums")))
    if table.count() * (len(sums) + p * (p + 1)) > PATTERN_NUMBERS:
        return _fit_on_rows(df, model, todo, max_rounds, limit)
    return _fit_on_patterns(rows, table.collect(), model, todo, max_rounds, limit)


@dataclass
class _Patterns:
    """Moments, around the means, of the rows of each pattern of missing columns."""

    names: list[tuple[int, ...]]
    missing: np.ndarray
    moments: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, table: Sequence, p: int) -> _Patterns:
        table = sorted(table, key=lambda r: tuple(r["_pattern"]))
        sums = np.array([r["sums"] for r in table])
        m = np.zeros((len(table), p + 1, p + 1))
        upper = np.triu_indices(p)
        m[:, 0, 0] = sums[:, 0]
        m[:, 0, 1:] = m[:, 1:, 0] = sums[:, 1 : p + 1]
        for k, (i, j) in enumerate(zip(*upper)):
            m[:, 1 + i, 1 + j] = m[:, 1 + j, 1 + i] = sums[:, 1 + p + k]
        names = [tuple(r["_pattern"]) for r in table]
        most = np.concatenate([np.ones((len(table), 1)), sums[:, -p:]], axis=1)
        return cls(names, np.array([_missing(n, p) for n in names]), m, most)

    def fit(self, maps: np.ndarray, target: int, others: list[int]) -> Moments:
        """Centred moments of the others and the target over the rows that have the target."""
        at = ~self.missing[:, target]
        a = np.concatenate([np.zeros((int(at.sum()), 1, maps.shape[2])), maps[at]], axis=1)
        a[:, 0, 0] = 1.0
        s = np.einsum("nij,njk,nlk->il", a, self.moments[at], a)
        n, o, t = s[0, 0], [1 + i for i in others], 1 + target
        return Moments(
            n, s[0, o] / n, s[0, t] / n, s[np.ix_(o, o)] - np.outer(s[0, o], s[0, o]) / n, s[o, t] - s[0, o] * s[0, t] / n,
            max(s[t, t] - s[0, t] ** 2 / n, 0.0),
        )


def _fit_on_patterns(rows: DataFrame, table: Sequence, model: ChainedImputer, todo: list[str], max_rounds: int, limit: float) -> ChainedImputer:
    cols = model.cols
    p = len(cols)
    place = {c: i for i, c in enumerate(cols)}
    mean = np.array([model.means[c] for c in cols])
    known = _Patterns.of(table, p)
    maps = first_maps(known.missing)
    doubt: list[tuple[int, np.ndarray]] = []

    def settled() -> int | None:
        """The first round in doubt whose largest move is within the limit, after one pass over the rows."""
        moves = _largest_moves(rows, model, known, [m for _, m in doubt])
        return next((r for (r, _), m in zip(doubt, moves) if m < limit), None)

    # A pass over the rows takes this many rounds' maps along.
    most = max(1, PATTERN_NUMBERS // maps.size)
    per_round = len(todo)
    for r in range(1, max_rounds + 1):
        before = maps.copy()
        for c in todo:
            t, others = place[c], [i for i in range(p) if i != place[c]]
            coef, intercept = bayesian_ridge(known.fit(maps, t, others))
            at = known.missing[:, t]
            maps[at, t] = step_maps(maps[at], others, coef, intercept)
            model.steps.append((c, [cols[i] for i in others], coef.tolist(), intercept + mean[t] - float(coef @ mean[others])))
        model.rounds = r
        move = maps - before
        # The root mean square is at most, the sum of absolute parts at least, the largest move.
        square = np.einsum("ncz,nzy,ncy->nc", move, known.moments, move) / known.moments[:, :1, 0]
        sure = (np.abs(move) * known.most[:, None, :]).sum(2).max() < limit
        if sure or np.sqrt(max(square.max(), 0.0)) < limit:
            doubt.append((r, move))
        if sure or len(doubt) >= most or (doubt and r == max_rounds):
            found = settled()
            doubt = []
            if found is not None:
                model.rounds, model.converged = found, True
                model.steps = model.steps[: found * per_round]
                break
    return model


def _largest_moves(rows: DataFrame, model: ChainedImputer, known: _Patterns, moves: list[np.ndarray]) -> list[float]:
    """The largest absolute move of any filled value in each of some rounds."""
    cols, p = model.cols, len(model.cols)
    mean = np.array([model.means[c] for c in cols])
    place = {n: i for i, n in enumerate(known.names)}
    every = np.array(moves)
    ship_code(rows.sparkSession)

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(len(moves))
        for batch in batches:
            at = np.array([place[tuple(m)] for m in batch["_pattern"]], int)
            z = np.concatenate([np.ones((len(batch), 1)), np.nan_to_num(batch[cols].to_numpy(float) - mean)], axis=1)
            for k in np.unique(at):
                here = np.abs(np.einsum("rcz,nz->rnc", every[:, k], z[at == k]))
                out = np.maximum(out, here.reshape(len(moves), -1).max(1))
        yield pd.DataFrame({"i": np.arange(len(moves)), "m": out})

    found = rows.mapInPandas(largest, "i int, m double").groupBy("i").agg(F.max("m").alias("m")).collect()
    by = {r["i"]: r["m"] for r in found}
    return [by.get(i, 0.0) for i in range(len(moves))]


def _fit_on_rows(df: DataFrame, model: ChainedImputer, todo: list[str], max_rounds: int, limit: float) -> ChainedImputer:
    """The same rounds with one aggregation over the rows per fit and a checkpoint per round."""
    cols = model.cols
    current = cut_lineage(model._start(df.select(*cols)))
    for _ in range(max_rounds):
        before = current.withColumns({f"_old_{c}": F.col(c) for c in todo})
        for c in todo:
            others = [o for o in cols if o != c]
            m = moments(before.filter(~F.col(f"_miss_{c}")), others, c, model.means)
            coef, intercept = bayesian_ridge(m)
            model.steps.append((c, others, coef.tolist(), intercept))
            before = before.withColumn(c, F.when(F.col(f"_miss_{c}"), linear(others, coef, intercept)).otherwise(F.col(c)))
        after = cut_lineage(before)
        moved = after.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(c) - F.col(f"_old_{c}")) for c in todo]))).first()[0]
        current = after.drop(*[f"_old_{c}" for c in todo])
        model.rounds += 1
        if moved is None or moved < limit:
            model.converged = True
            break
    return model
