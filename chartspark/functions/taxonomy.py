"""Chart families: a rule cascade and a dictionary. The two disagree on purpose; both are kept."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspark.functions.text import bound, strip, type_text

# Fixed values: (family, words the text contains, texts it equals); the first match wins.
FAMILY_RULES = (
    ("Confusion Matrix", ("confusion",), ()),
    ("Heatmap", ("heatmap", "heat map", "correlation"), ()),
    ("Error Bar", ("error bar", "errorbar"), ()),
    ("Faceted Plot", ("facet", "subplot", "multi panel"), ()),
    ("Hexbin", ("hexbin",), ()),
    ("Contour / Field", ("contour", "quiver"), ()),
    ("3D Surface", ("3d surface",), ()),
    ("3D Scatter", ("3d scatter", "scatter 3d"), ()),
    ("Scatter Matrix", ("scatter matrix", "pair plot", "pairplot", "pair grid", "pairwise"), ()),
    ("Parallel Coordinates", ("parallel coordinate",), ()),
    ("Projection Plot", ("pca", "projection", "biplot"), ()),
    ("Radar Chart", ("radar",), ()),
    ("Bubble Chart", ("bubble",), ()),
    ("Pie / Donut", ("pie", "donut"), ()),
    ("Set / Composition", ("treemap", "sunburst", "mosaic", "upset"), ()),
    ("Histogram", ("histogram",), ("hist",)),
    ("Distribution Summary", ("ecdf", "cumulative distribution", "cdf", "qq plot", "q q plot"), ()),
    ("Density Plot", ("density", "kde", "ridge"), ()),
    ("Box / Violin", ("violin", "boxen", "boxplot", "box plot", "box and whisker", "raincloud"), ("box",)),
    ("Categorical Scatter", ("swarm", "strip", "jitter", "dot plot"), ("dot",)),
    ("Scatter Plot", ("regression", "residual", "scatter", "jointplot"), ("point",)),
    ("Scatter Matrix", (), ("pair",)),
    ("Heatmap", ("image plot",), ()),
    ("Sequence Logo", ("sequence logo",), ()),
    ("Line / Area", ("line", "time series", "step", "area"), ()),
    ("Bar Chart", ("bar", "count plot", "lollipop"), ()),
)

# Exact lower-case spellings and their family.
FAMILY_OF_SPELLING = {
    "bar chart": "Bar Chart",
    "bar plot": "Bar Chart",
    "grouped bar chart": "Bar Chart",
    "stacked bar chart": "Bar Chart",
    "horizontal bar chart": "Bar Chart",
    "line chart": "Line Plot",
    "line plot": "Line Plot",
    "area chart": "Area Plot",
    "area plot": "Area Plot",
    "scatter plot": "Scatter Plot",
    "scatter chart": "Scatter Plot",
    "bubble chart": "Bubble Chart",
    "bubble plot": "Bubble Chart",
    "histogram": "Histogram",
    "density plot": "Density Plot",
    "kde plot": "Density Plot",
    "box plot": "Box / Violin",
    "boxplot": "Box / Violin",
    "violin plot": "Box / Violin",
    "heatmap": "Heatmap",
    "correlation heatmap": "Heatmap",
    "hexbin plot": "Hexbin",
    "hexbin": "Hexbin",
    "scatterplot matrix": "Scatter Matrix",
    "scatter matrix": "Scatter Matrix",
    "pair plot": "Scatter Matrix",
    "pairplot": "Scatter Matrix",
    "parallel coordinates": "Parallel Coordinates",
    "radar chart": "Radar Chart",
    "spider chart": "Radar Chart",
    "pie chart": "Pie Chart",
    "donut chart": "Pie Chart",
    "treemap": "Treemap",
    "ecdf plot": "ECDF / Q-Q",
    "q-q plot": "ECDF / Q-Q",
    "qq plot": "ECDF / Q-Q",
    "strip plot": "Categorical Scatter",
    "swarm plot": "Categorical Scatter",
    "jitter plot": "Categorical Scatter",
    "dot plot": "Categorical Scatter",
    "error bar plot": "Error Bar",
    "error bar chart": "Error Bar",
    "faceted plot": "Faceted Plot",
    "facet grid": "Faceted Plot",
    "projection plot": "Projection Plot",
    "pca plot": "Projection Plot",
    "sequence logo": "Sequence Logo",
    "3d surface": "3D Surface",
    "3d surface plot": "3D Surface",
}


def family_by_rules(raw: Column) -> Column:
    """Family of the first matching rule; without a match the stripped spelling.

    The rules read the reduced text some sixty times, so it is bound once.
    """
    given = F.coalesce(raw, F.lit(""))

    def cascade(text: Column) -> Column:
        family = F.when(text == "", "Unknown")
        for name, parts, wholes in FAMILY_RULES:
            tests = [F.contains(text, F.lit(p)) for p in parts] + [text == w for w in wholes]
            hit = tests[0]
            for test in tests[1:]:
                hit = hit | test
            family = family.when(hit, name)
        return family

    return F.coalesce(bound(type_text(given), cascade), strip(given))


def family_by_spelling(raw: Column) -> Column:
    """Family of an exact spelling, else the stripped spelling, else "Unknown".

    The dictionary is a constant in the plan, so no join is needed.
    """
    given = strip(F.coalesce(raw, F.lit("")))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(FAMILY_OF_SPELLING.items())])
    return F.coalesce(F.try_element_at(known, F.lower(given)), F.when(given == "", "Unknown").otherwise(given))
