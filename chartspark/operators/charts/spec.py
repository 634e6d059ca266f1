"""Run a chart specification: filters, transformations, binning, grouping, aggregation."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.operators.charts.common import aggregated, bin_index, limits
from chartspark.schemas import STRUCTURED_KEYS


class Chart(NamedTuple):
    """The plotted table and its one-row description."""

    graph_df: DataFrame
    graph_data: DataFrame


def run_spec(df: DataFrame, spec: Mapping) -> Chart:
    """Build the plotted table of a specification.

    Keys, all optional but `plot_type`: `filters` (SQL conditions), `transformations`
    (name → SQL expression), `binning` (column → number of equal bins, or {"width": w}),
    `x`, `hue`, `facet` (a name or a list), `y`, `aggregation`, `title`. Without an
    aggregation the rows themselves are plotted.
    """
    rows = df
    for condition in spec.get("filters", ()):
        rows = rows.where(condition)
    for name, expression in spec.get("transformations", {}).items():
        rows = rows.withColumn(name, F.expr(expression))
    binning = spec.get("binning", {})
    equal = [c for c, how in binning.items() if not isinstance(how, Mapping)]
    ends = limits(rows, *equal) if equal else None
    binned = {}
    for column, how in binning.items():
        value = F.col(column).cast("double")
        if isinstance(how, Mapping):
            binned[column] = F.floor(value / F.lit(float(how["width"]))) * F.lit(float(how["width"]))
        else:
            low, high = ends[f"min_{column}"], ends[f"max_{column}"]
            binned[column] = low + bin_index(value, low, high, int(how)) * (high - low) / F.lit(int(how))
    if binned:
        rows = rows.withColumns(binned)

    keys = list(dict.fromkeys(_listed(spec.get("x")) + _listed(spec.get("hue")) + _listed(spec.get("facet"))))
    y, agg = spec.get("y"), spec.get("aggregation")
    if agg:
        plotted = aggregated(rows, keys, y, agg, out=y or "count")
    else:
        plotted = rows.select(*dict.fromkeys(keys + _listed(y)))

    used = list(dict.fromkeys(keys + _listed(y)))
    derived = list(spec.get("transformations", {}))
    n_in = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_out = plotted.agg(F.count(F.lit(1)).alias("n")).scalar()
    texts = {
        "plot_type": F.lit(spec["plot_type"]),
        "features_expected": _texts(spec.get("features", [c for c in used if c in df.columns])),
        "features_used": _texts(used),
        "derived_features": _texts(derived),
        "x": _texts(_listed(spec.get("x"))), "y": _texts(_listed(y)), "hue": _texts(_listed(spec.get("hue"))),
        "facet": _texts(_listed(spec.get("facet"))),
        "aggregation": _texts(_listed(agg)),
        "binning": _texts([f"{c}: {how}" for c, how in binning.items()]),
        "transformations": _texts([f"{n} = {e}" for n, e in spec.get("transformations", {}).items()]),
        "filters": _texts(list(spec.get("filters", ()))),
        "n_rows_input": n_in, "n_rows_plotted": n_out,
        "title": F.lit(spec.get("title")).cast("string"),
    }
    one = df.sparkSession.range(1)
    return Chart(plotted, one.select(*[texts[k].alias(k) for k in STRUCTURED_KEYS]))


def _listed(value) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def _texts(values: list[str]):
    return F.array(*[F.lit(x) for x in values]).cast("array<string>")
