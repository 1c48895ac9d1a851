"""Column functions on journal text and on report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of an alarm mark, case and outer space aside (fixed values of the journal format).
TRUE_TOKENS, FALSE_TOKENS = ("true", "t"), ("false", "f")


def parse_bool_token(c: Column) -> Column:
    """Boolean of a token, null for any other text."""
    token = F.lower(F.trim(c))
    return F.when(token.isin(*TRUE_TOKENS), F.lit(True)).when(token.isin(*FALSE_TOKENS), F.lit(False))


def finite_double(c: Column) -> Column:
    """Whether text is a finite number."""
    x = c.try_cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def readable(c: Column, kind: str) -> Column:
    """Text of a factor: ``percent``, ``count`` (thousands apart) or ``number`` (one decimal); ``no data`` for null."""
    if kind == "percent":
        text = F.concat(F.round(c * 100).cast("long").cast("string"), F.lit(" %"))
    elif kind == "count":
        text = F.replace(F.format_number(c.cast("double"), 0), F.lit(","), F.lit(" "))
    else:
        text = F.round(c, 1).cast("decimal(38,1)").cast("string")
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit("no data")).otherwise(text)


def verdict(score: Column, threshold: Column, object_id: Column, suspects: Column, most: int = 3) -> Column:
    """One line about an object: whether it is at risk, how likely, and the first suspects."""
    level = F.when(score >= threshold, F.lit("at risk")).otherwise(F.lit("calm"))
    likely = F.concat(F.round(score * 100).cast("long").cast("string"), F.lit(" %"))
    named = F.when(F.size(suspects) > 0, F.concat(F.lit("see "), F.concat_ws(", ", F.slice(suspects, 1, most))))
    return F.concat_ws("; ", F.concat(object_id, F.lit(" "), level), likely, named)
