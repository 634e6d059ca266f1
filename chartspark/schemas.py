"""Schemas of stored chart records, results and summaries."""

from __future__ import annotations

# Schemas are DDL texts, so that this module loads without a session.
QUESTION = "struct<question:string,answer:string,answer_basis:string,type:string>"

# `images` holds objects, and in old files bare strings; `structured_data` mixes texts and lists.
RECORD = (
    "id string, dataset struct<id:string,description:string>, "
    "graph struct<type:string,style:string,full_description:string,short_description:string,code:string,"
    f"structured_data:variant,questions:array<{QUESTION}>>, images array<variant>"
)

RESULT = (
    f"chart_id string, graph_id string, dataset_id string, graph_type string, image string, question {QUESTION}, "
    "dataset_description string, test_answer string, correct boolean, answer_error string, check_error string"
)

SUMMARY = "model string, type string, correct bigint, incorrect bigint, accuracy double"

USAGE = "model string, phase string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, cost double"

# The keys of structured chart data.
STRUCTURED_KEYS = (
    "plot_type", "features_expected", "features_used", "derived_features", "x", "y", "hue", "facet",
    "aggregation", "binning", "transformations", "filters", "n_rows_input", "n_rows_plotted", "title",
)

# Keys that hold a text, nothing, or a list of texts.
TEXT_OR_LIST_KEYS = ("x", "y", "hue", "aggregation", "binning")
