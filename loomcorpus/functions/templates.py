"""URL templates with {{variables}} and the value lists that fill them."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ascending ranges that span more stay literal.
MAX_RANGE = 10_000
MAX_URLS = 50_000


def variables(template: Column) -> Column:
    """The variables' names, each once, as first seen."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), 1))


def expand_values(expr: Column) -> Column:
    """The values of a comma list with ranges: 1,x,5-7 gives 1 x 5 6 7; ranges may descend."""
    parts = F.filter(F.transform(F.split(expr, ","), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(-?\d+)-(\d+)$", 1).try_cast("long")
        b = F.regexp_extract(p, r"^(-?\d+)-(\d+)$", 2).try_cast("long")
        return F.when(a.isNull() | b.isNull() | (b - a > MAX_RANGE), F.array(p)).otherwise(F.transform(F.sequence(a, b), lambda v: v.cast("string")))

    return F.flatten(F.transform(parts, one))


def expand(spark: SparkSession, template: str, given: dict[str, str], most: int = MAX_URLS) -> DataFrame:
    """(url): the template with every combination of its variables' values.

    A variable without values, or more than `most` URLs, is an error. Variables are replaced in order, so a value that holds a later
    variable is expanded as well.
    """
    one = spark.range(1).select(F.lit(template).alias("url"))
    names = one.select(variables(F.col("url")).alias("v")).first().v
    lists = one.select(*(expand_values(F.lit(given.get(n, ""))).alias(f"v{k}") for k, n in enumerate(names))).first() if names else ()
    for n, v in zip(names, lists):
        if not v:
            raise ValueError(f"no values for {n}")
    if prod(map(len, lists)) > most:
        raise ValueError(f"more than {most} URLs")
    for n, v in zip(names, lists):
        one = one.crossJoin(spark.createDataFrame([(x,) for x in v], "value string")).select(F.replace("url", F.lit("{{" + n + "}}"), F.col("value")).alias("url"))
    return one


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0.0)))


def cut(text: Column, size: int) -> Column:
    """text's first `size` bytes; a character that they would part is left out."""
    part = lambda n: F.try_validate_utf8(F.substring(text.cast("binary"), 1, max(n, 0)).cast("string"))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*(part(size - k) for k in range(4))))
