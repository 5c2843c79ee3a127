"""Small column expressions; all of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from driftpanel.spec import STATE_NAMES, PanelSpec


def r6(column: Column | str) -> Column:
    """Round to six places; adding zero turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def is_finite(name: str) -> Column:
    c = F.col(name).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def qc_rule(spec: PanelSpec) -> Column:
    return (F.col("shift") <= spec.max_shift) & (F.col("noise") < spec.max_noise)


def arm_rank(spec: PanelSpec, arm: str = "arm") -> Column:
    """Ordinal rank of an arm; NULL for an arm the study does not know."""
    pairs = [F.lit(v) for i, a in enumerate(spec.arms) for v in (a, i)]
    return F.try_element_at(F.create_map(*pairs), F.col(arm))


def stratum(arm: str = "arm", target: str = "target") -> Column:
    """``arm__target``; an unknown target is a stratum of its own."""
    label = F.coalesce(F.col(target).cast("string"), F.lit("missing"))
    return F.concat_ws("__", F.col(arm), label)


def hour_of_day(ts: str = "started_at") -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def alarm(score: str, threshold: float = 0.5) -> Column:
    return F.col(score) >= F.lit(threshold)


def log1p_features(columns: Sequence[str]) -> list[Column]:
    return [F.log1p(F.col(c).cast("double")).alias(c) for c in columns]


def state_label(state: Column, n_states: int) -> Column:
    """``"2 (name)"``; raises for a state count or state without a fixed name."""
    names = STATE_NAMES.get(n_states)
    if names is None:
        raise ValueError(f"no names are defined for {n_states} states")
    lookup = F.create_map(*[F.lit(v) for item in names.items() for v in item])
    name = F.coalesce(
        F.try_element_at(lookup, state.cast("int")),
        F.raise_error(F.concat(F.lit("state without a name: "), state.cast("string"))),
    )
    return F.format_string("%d (%s)", state.cast("int"), name)


# --- small vectors and matrices held in array columns -------------------------------


def permute(values: Column, order: Column) -> Column:
    """``values[order[i]]`` for every i."""
    return F.transform(order, lambda i: F.get(values, i.cast("int")))


def expected_index(probabilities: Column) -> Column:
    """Sum of k times p_k."""
    weighted = F.transform(probabilities, lambda p, i: p * i)
    return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)


def vector_times_matrix(vector: Column, matrix: Column, width: int) -> Column:
    """Row vector times a matrix stored as an array of rows."""

    def entry(j: int) -> Column:
        products = F.zip_with(vector, matrix, lambda p, row: p * F.get(row, F.lit(j)))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.array(*[entry(j) for j in range(width)])


def propagate(probability: Column, matrix: Column, steps: Column, width: int) -> Column:
    """State distribution after ``steps`` transitions; a negative count is an error."""
    checked = F.when(steps < 0, F.raise_error(F.lit("forecast steps cannot be negative")).cast("int")).otherwise(
        steps.cast("int")
    )
    # sequence(1, 0) would count down, so zero steps gets an empty array
    walk = F.when(checked > 0, F.sequence(F.lit(1), checked)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(walk, probability, lambda p, _: vector_times_matrix(p, matrix, width))
