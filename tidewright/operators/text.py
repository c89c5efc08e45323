"""News text: tags, near-equal titles, mark-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title_key(title: str) -> Column:
    """Letters and digits of a title alone, lower case: equal for titles that differ in punctuation and spaces."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^\\p{L}\\p{N}]+", "")


def newest(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row a key, the first by order; keys are ranked within tasks before the shuffle."""
    w = Window.partitionBy("__k").orderBy(*order)
    return df.withColumn("__k", key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__k", "__n")


def plain(html: str) -> Column:
    """Text of mark-up: scripts, styles, comments and tags out, five entities resolved, white space closed up."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def tagged(text: str, tags: dict[str, str]) -> Column:
    """Names of the tags whose pattern occurs."""
    return F.array_compact(F.array(*[F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(p), F.lit(n)) for n, p in tags.items()]))
