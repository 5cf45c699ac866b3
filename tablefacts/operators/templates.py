"""Text templates: filling in facts and finding what was left unfilled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import FACTS

# A placeholder is a fact's name in capitals between double braces.
OPEN, CLOSE = "{{", "}}"


def placeholder(fact: str) -> str:
    return OPEN + fact.upper() + CLOSE


def filled(template: Column) -> Column:
    """The template with every placeholder replaced by the fact column of that name."""
    for fact in FACTS:
        template = F.replace(template, F.lit(placeholder(fact)), F.col(fact))
    return template


def fill_template(texts: DataFrame, facts: DataFrame, text_col: str = "insight_text") -> DataFrame:
    """Fill the templates of specs from their facts, matched on ``spec_id``; a spec
    without facts keeps its template."""
    joined = texts.join(facts.select("spec_id", *FACTS), "spec_id", "left")
    text = F.coalesce(filled(F.col(text_col)), F.col(text_col))
    return joined.withColumn(text_col, text).select(*texts.columns)


def is_unfilled(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(OPEN)), F.lit(False))


def unfilled(texts: DataFrame, text_col: str = "insight_text") -> DataFrame:
    """The rows whose text still has an opening double brace."""
    return texts.where(is_unfilled(F.col(text_col)))
