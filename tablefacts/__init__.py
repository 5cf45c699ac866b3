"""Verified summary numbers from sets of tables."""

from .operators.facts import category_totals, insight_facts
from .operators.kpi import compute_kpis
from .operators.median import exact_medians
from .operators.profile import (
    condense,
    drop_identifier_columns,
    infer_types,
    profile_table,
    profile_to_json,
    profile_workspace,
    top_values,
)
from .operators.series import chart_series, table_cells, table_extract
from .operators.templates import fill_template, unfilled
from .plans.run import Run, run_specs
from .plans.specs import catalog, parse_specs, resolve_requests
from .sources.cleanup import clean_table, normalize_missing, validate_workspace
from .sources.refresh import refresh_profile
from .sources.workspace import load_table, load_workspace

__all__ = [
    "Run",
    "catalog",
    "category_totals",
    "chart_series",
    "clean_table",
    "compute_kpis",
    "condense",
    "drop_identifier_columns",
    "exact_medians",
    "fill_template",
    "infer_types",
    "insight_facts",
    "load_table",
    "load_workspace",
    "normalize_missing",
    "parse_specs",
    "profile_table",
    "profile_to_json",
    "profile_workspace",
    "refresh_profile",
    "resolve_requests",
    "run_specs",
    "table_cells",
    "table_extract",
    "top_values",
    "unfilled",
    "validate_workspace",
]
