"""Identifiers: tidying, and an injective split into a namespace and an integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around an id.
BLANKS = " \t\n\r 　"


def clean_id(column: Column | str) -> Column:
    """Lower case without blanks around it; NULL where the id refers to nothing."""
    c = F.col(column) if isinstance(column, str) else column
    tidy = F.lower(F.trim(c, F.lit(BLANKS)))
    return F.when(tidy != "", tidy)


def integer_key(key: Column) -> tuple[Column, Column]:
    """``(namespace, integer)`` of a tidy id; two ids have the same pair only if they are equal.

    * an id that ends in twelve hexadecimal digits: the text before them and their value (48 bits);
    * else an id that ends in a decimal number of up to 15 digits without leading zeros: likewise;
    * any other id: the whole id and 0.
    """
    tail = F.right(key, F.lit(12))
    is_hex = tail.rlike("^[0-9a-f]{12}$")
    decimal = "^((?:.*[^0-9])?)(0|[1-9][0-9]{0,14})$"
    is_decimal = key.rlike(decimal)
    space = (
        F.when(is_hex, F.concat(F.lit("h:"), F.substr(key, F.lit(1), F.length(key) - 12)))
        .when(is_decimal, F.concat(F.lit("d:"), F.regexp_extract(key, decimal, 1)))
        .otherwise(F.concat(F.lit("s:"), key))
    )
    number = (
        F.when(is_hex, F.conv(tail, 16, 10).cast("bigint"))
        .when(is_decimal, F.regexp_extract(key, decimal, 2).try_cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    return space, number
