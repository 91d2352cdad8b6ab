"""A whole evaluation run, claims about it, and the audit of a dataset, as long tables.

A run's result has one row a fact: (section, slice_name, scorer, name, value,
status, detail). Sections are ``size``, ``metric``, ``paired_diff``,
``operating_point``, ``leakage``, ``error`` and ``source_role``. All slices and
scorers are computed in one plan a section; gates are aggregates over the result,
evaluated together in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators import eda as E
from tallywright.operators import leakage as L
from tallywright.operators import metrics as M
from tallywright.operators import resample as R
from tallywright.operators import select as S
from tallywright.plans.evaluate import scorecard
from tallywright.session import cut

RESULT = "section string, slice_name string, scorer string, name string, value double, status string, detail string"
SELECTORS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "max_f1": S.max_f1, "youden_j": S.youden_j, "recall_90": lambda d, k: S.target_recall(d, k, 0.9), "recall_95": lambda d, k: S.target_recall(d, k, 0.95),
    "precision_90": lambda d, k: S.target_precision(d, k, 0.9), "fpr_05": lambda d, k: S.target_fpr(d, k, 0.05),
}


@dataclass(frozen=True)
class OperatingPoints:
    """Thresholds fitted on one slice by named selectors, applied to others (all of them if none is named)."""

    fit_slice: str
    selectors: tuple[str, ...] = ("max_f1",)
    targets: tuple[str, ...] = ()


def facts(df: DataFrame, section: str, name, value, status=None, detail=None) -> DataFrame:
    """Rows of the result; missing columns are null."""
    have = set(df.columns)
    col = lambda c, other: (F.col(c) if c in have else F.lit(other)).cast("string").alias(c)
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(section).alias("section"), col("slice_name", None), col("scorer", None), as_column(name).cast("string").alias("name"), as_column(value).cast("double").alias("value"),
        as_column(status if status is not None else "ok").cast("string").alias("status"), as_column(detail).cast("string").alias("detail"),
    )


def score_grid(rows: DataFrame, scorers: Mapping[str, Callable[[DataFrame], Column]], row_id: str = "row_id", label: str = "label", record: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """(slice_name, scorer, row_id, y, s) of every scorer on every row, and the scorers that failed with why.

    A scorer gives a column over the rows. With ``record`` one that cannot be
    planned, or fails on the rows, is left out and told; the others are not
    touched by it.
    """
    parts, failed = None, {}
    d = rows.where(F.col(label).isin(0, 1))
    for name, f in scorers.items():
        try:
            x = d.select("slice_name", F.lit(name).alias("scorer"), row_id, F.col(label).cast("int").alias("y"), f(d).cast("double").alias("s"))
            x = cut(x.where("s is not null and not isnan(s) and abs(s) <= 1 and s >= 0"))  # a failure shows here, not in the plan of all scorers
        except Exception as error:
            if not record:
                raise
            failed[name] = f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"
            continue
        parts = x if parts is None else parts.unionByName(x)
    if parts is None:
        parts = d.select("slice_name", F.lit("").alias("scorer"), row_id, F.lit(0).alias("y"), F.lit(0.0).alias("s")).where("false")
    return parts, failed


def evaluate(
    scores: DataFrame, pairs: Sequence[tuple[str, str]] = (), points: Sequence[OperatingPoints] = (), leakage: DataFrame | None = None, on_leakage: str = "raise",
    severity: Mapping[str, str] | None = None, failed: Mapping[str, str] | None = None, unit: str = "row_id", reps: int = 1000,
) -> DataFrame:
    """The result of a run over scores (slice_name, scorer, unit, y, s): sizes, metrics, paired differences, transferred operating points, leakage.

    leakage: (check_name, split, row_id) as the checks give it; severities by
    check name, "error" where none is given. on_leakage: ``raise`` (RuntimeError
    if an error is found), ``record`` or ``skip``. Scores are null-free; a slice
    of one class has its undefined metrics as ``skipped``.
    """
    spark = scores.sparkSession
    if on_leakage not in ("raise", "record", "skip"):
        raise ValueError(f"unknown on_leakage {on_leakage}")
    keys = ["slice_name", "scorer"]
    out = []
    if leakage is not None and on_leakage != "skip":
        found = cut(leakage.groupBy("check_name").agg(F.count_distinct("row_id").alias("n")))
        levels = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])[F.col("check_name")] if severity else F.lit(None).cast("string")
        found = found.withColumn("level", F.coalesce(levels, F.lit("error")))
        if on_leakage == "raise" and (bad := found.where("level = 'error'").first()):
            raise RuntimeError(f"leakage: {bad['check_name']} affects {bad['n']} rows")
        out.append(facts(found, "leakage", F.col("check_name"), F.col("n"), F.col("level")))
    for name, why in (failed or {}).items():
        out.append(spark.createDataFrame([("error", None, name, "scorer_error", None, "error", why)], RESULT))
    sizes = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"))
    both = F.explode(F.array(F.struct(F.lit("n").alias("k"), F.col("n").alias("v")), F.struct(F.lit("n_positive").alias("k"), F.col("n_positive").alias("v")))).alias("x")
    out.append(facts(sizes.select(*keys, both), "size", F.col("x.k"), F.col("x.v")))
    card = scorecard(scores, keys)
    out.append(facts(card, "metric", F.col("metric"), F.col("value"), F.col("status"), F.col("reason")))
    for a, b in pairs:
        d = R.paired_diff(scores, ["slice_name"], "scorer", a, b, unit=unit, reps=reps)
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in ("ci_low", "ci_high", "overlaps_zero", "mde", "n_resamples")])).alias("x")
        out.append(facts(d.withColumn("overlaps_zero", F.col("overlaps_zero").cast("int")).select("slice_name", F.lit(f"{b}-{a}").alias("scorer"), values), "paired_diff", F.col("x.k"), F.col("x.v")))
    for p in points:
        out.append(transferred(scores, p))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def transferred(scores: DataFrame, p: OperatingPoints) -> DataFrame:
    """Facts of p: the threshold of each scorer and selector, and the rates at it on every target slice. A fit slice without rows gives one error."""
    fit = scores.where(F.col("slice_name") == p.fit_slice)
    fitted = None
    for name in p.selectors:
        x = SELECTORS[name](fit, ["slice_name", "scorer"]).select("scorer", F.lit(name).alias("selector"), "t")
        fitted = x if fitted is None else fitted.unionByName(x)
    targets = scores.where(F.col("slice_name").isin(*p.targets)) if p.targets else scores
    c = M.confusion_at(targets.join(fitted, "scorer"), ["slice_name", "scorer", "selector"])
    names = ("t", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")
    x = c.select("slice_name", "scorer", "selector", F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("double").alias("v")) for n in names])).alias("x"))
    good = facts(x, "operating_point", F.concat(F.lit(f"{p.fit_slice}:"), F.col("selector"), F.lit(":"), F.col("x.k")), F.col("x.v"))
    none = fit.agg(F.count("*").alias("n")).where("n = 0")
    return good.unionByName(facts(none, "operating_point", p.fit_slice, None, "error", f"fit slice {p.fit_slice} has no rows"))


# --- claims -----------------------------------------------------------------


@dataclass(frozen=True)
class Gate:
    """A check of a result: an aggregate that is true, and the number that it looked at."""

    name: str
    passed: Column
    value: Column
    severity: str = "error"


def _where(section: str, slice_name: str | None = None, scorer: str | None = None, name: str | None = None) -> Column:
    c = F.col("section") == section
    for column, v in (("slice_name", slice_name), ("scorer", scorer), ("name", name)):
        if v is not None:
            c = c & (F.col(column) == v)
    return c


def _value(section: str, **at) -> Column:
    return F.max(F.when(_where(section, **at), F.col("value")))


def _count(c: Column) -> Column:
    return F.count_if(c).cast("double")


def _sizes(slice_name: str) -> tuple[Column, Column]:
    return _value("size", slice_name=slice_name, name="n"), _value("size", slice_name=slice_name, name="n_positive")


_COMPARE: dict[str, Callable[[Column, float], Column]] = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b,
}


def required_slice(slice_name: str, severity: str = "error") -> Gate:
    n = _count(_where("size", slice_name))
    return Gate(f"required_slice:{slice_name}", n > 0, n, severity)


def required_scorer(slice_name: str, scorer: str, severity: str = "error") -> Gate:
    n = _count(_where("size", slice_name, scorer))
    return Gate(f"required_scorer:{slice_name}/{scorer}", n > 0, n, severity)


def required_metric(slice_name: str, scorer: str, metric: str, severity: str = "error") -> Gate:
    v = _value("metric", slice_name=slice_name, scorer=scorer, name=metric)
    return Gate(f"required_metric:{slice_name}/{scorer}/{metric}", v.isNotNull(), v, severity)


def minimum_slice_size(slice_name: str, n: int = 1, positive: int = 0, negative: int = 0, severity: str = "error") -> Gate:
    rows, pos = _sizes(slice_name)
    return Gate(f"minimum_slice_size:{slice_name}", (rows >= n) & (pos >= positive) & (rows - pos >= negative), rows, severity)


def low_fpr_feasibility(slice_name: str, max_fpr: float, confidence: float = 0.95, severity: str = "error") -> Gate:
    """Whether even no false positive at all would prove the rate: the Wilson upper bound of 0 of the negatives."""
    if not 0 < max_fpr <= 1 or not 0 < confidence < 1:
        raise ValueError("max_fpr must be in (0, 1] and confidence in (0, 1)")
    rows, pos = _sizes(slice_name)
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    bound = F.when(rows > pos, z * z / (rows - pos + z * z))
    return Gate(f"low_fpr_feasibility:{slice_name}", bound <= max_fpr, bound, severity)


def paired_diff_present(slice_name: str, a: str, b: str, severity: str = "error") -> Gate:
    v = _value("paired_diff", slice_name=slice_name, scorer=f"{b}-{a}", name="n_resamples")
    return Gate(f"paired_diff_present:{slice_name}/{b}-{a}", v > 0, v, severity)


def headline_present(metric: str = "pr_auc", severity: str = "error") -> Gate:
    n = _count(_where("metric", name=metric) & F.col("value").isNotNull())
    return Gate(f"headline_present:{metric}", n > 0, n, severity)


def metric_threshold(slice_name: str, scorer: str, metric: str, op: str, threshold: float, severity: str = "error") -> Gate:
    v = _value("metric", slice_name=slice_name, scorer=scorer, name=metric)
    return Gate(f"metric_threshold:{slice_name}/{scorer}/{metric}", _COMPARE[op](v, threshold), v, severity)


def external_diagnostic(slice_name: str, scorer: str, metric: str, op: str, threshold: float, severity: str = "warning") -> Gate:
    """A metric of an outside slice, as a warning."""
    g = metric_threshold(slice_name, scorer, metric, op, threshold, severity)
    return Gate(f"external_diagnostic:{slice_name}/{scorer}/{metric}", g.passed, g.value, severity)


def no_scorer_errors(severity: str = "error") -> Gate:
    n = _count(F.col("section") == "error")
    return Gate("no_scorer_errors", n == 0, n, severity)


def no_leakage_errors(severity: str = "error") -> Gate:
    n = _count((F.col("section") == "leakage") & (F.col("status") == "error"))
    return Gate("no_leakage_errors", n == 0, n, severity)


def source_role(source: str, role: str, severity: str = "error") -> Gate:
    n = _count(_where("source_role", name=source) & (F.col("detail") == role))
    return Gate(f"source_role:{source}={role}", n > 0, n, severity)


def strict_artifact(severity: str = "error") -> Gate:
    """No value that JSON cannot hold."""
    n = _count(F.isnan("value") | (F.abs("value") == float("inf")))
    return Gate("strict_artifact", n == 0, n, severity)


def check_gates(result: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """(gate, passed, severity, value), in one pass over the result; what a gate looks at and does not find fails it."""
    g = result.agg(*[F.coalesce(x.passed, F.lit(False)).alias(f"p{i}") for i, x in enumerate(gates)], *[x.value.cast("double").alias(f"v{i}") for i, x in enumerate(gates)])
    rows = F.explode(F.array(*[F.struct(F.lit(x.name).alias("gate"), F.col(f"p{i}").alias("passed"), F.lit(x.severity).alias("severity"), F.col(f"v{i}").alias("value")) for i, x in enumerate(gates)])).alias("x")
    return g.select(rows).select("x.*")


def claim_report(result: DataFrame, claims: Mapping[str, Sequence[Gate]]) -> DataFrame:
    """(claim, supported, n_gates, n_failed, n_warnings): a claim is supported if none of its error gates fails."""
    parts = None
    for name, gates in claims.items():
        x = check_gates(result, gates).withColumn("claim", F.lit(name))
        parts = x if parts is None else parts.unionByName(x)
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    return parts.groupBy("claim").agg((bad("error") == 0).alias("supported"), F.count("*").alias("n_gates"), bad("error").alias("n_failed"), bad("warning").alias("n_warnings"))


# --- datasets ---------------------------------------------------------------


def summarize_splits(rows: DataFrame, context_window: int | None = None, split: str = "split", text: str = "text", label: str = "label") -> DataFrame:
    """One row a split: class balance, lengths in characters, words and (with a context window) tokens of the public byte tokenizer, share of texts over the window."""
    g = E.class_balance(rows, [split], label).join(E.length_quantiles(rows, [split], text), split, "full")
    if context_window is None:
        return g
    size = F.octet_length(text) + 1
    q = F.percentile(size, F.array(F.lit(0.5), F.lit(0.95)))
    t = rows.where(F.col(text).isNotNull()).groupBy(split).agg(q.alias("q"), F.max(size).cast("bigint").alias("token_max"), F.avg((size > context_window).cast("double")).alias("over_window"))
    return g.join(t.select(split, F.col("q")[0].alias("token_p50"), F.col("q")[1].alias("token_p95"), "token_max", "over_window"), split, "full")


def audit_dataset(rows: DataFrame, context_window: int | None = None, low: float = 0.1, high: float = 10.0, over: float = 0.05, train: str = "train") -> DataFrame:
    """(gate, split, passed, severity, value) of a corpus (row_id, split, text, label).

    class_balance: negatives a positive within [low, high] and two classes;
    no_cross_split_leakage: rows of other splits whose normal text is in train;
    context_window_fit: share of texts over the window; exact_duplicates: rows
    behind the first copy, as a warning. Null splits are left out.
    """
    s = summarize_splits(rows.where("split is not null"), context_window)
    gate = lambda name, passed, value, severity="error": F.struct(F.lit(name).alias("gate"), passed.alias("passed"), F.lit(severity).alias("severity"), value.cast("double").alias("value"))
    gates = [gate("class_balance", F.coalesce(~F.col("single_class") & F.col("neg_pos_ratio").between(low, high), F.lit(False)), F.col("neg_pos_ratio"))]
    if context_window is not None:
        gates.append(gate("context_window_fit", F.coalesce(F.col("over_window") <= over, F.lit(True)), F.col("over_window")))
    for name, found, severity in (("no_cross_split_leakage", L.cross_split_exact(rows, train), "error"), ("exact_duplicates", L.exact_duplicates(rows), "warning")):
        n = found.groupBy("split").agg(F.count_distinct("row_id").alias(name))
        s = s.join(n, "split", "left")
        gates.append(gate(name, F.coalesce(name, F.lit(0)) == 0, F.coalesce(name, F.lit(0)), severity))
    return s.select("split", F.explode(F.array(*gates)).alias("x")).select("x.gate", "split", "x.passed", "x.severity", "x.value")
