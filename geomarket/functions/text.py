"""Text columns: search strings, coordinate extraction, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a bracketed pair of signed decimals.
PAIR_PATTERN = r"\[(-?\d+(?:\.\d+)?, ?-?\d+(?:\.\d+)?)\]"


def year_month(date: Column) -> Column:
    """``yyyyMM`` as an integer."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def five_places(value: Column) -> Column:
    """Rounded to five places, trailing zeros dropped but one decimal kept."""
    return F.regexp_replace(F.format_string("%.5f", value), r"(\.\d+?)0*$", "$1")


def search_string(first: Column, second: Column, separator: str = " ") -> Column:
    """Two coordinates to five places; the caller picks the order."""
    return F.concat(five_places(first), F.lit(separator), five_places(second))


def wkt_rings(wkt: Column) -> Column:
    """The coordinates of every ring, of all parts and holes, in the order of the text."""
    innermost = F.regexp_extract_all(wkt, F.lit(r"\(([^()]*)\)"), F.lit(1))
    return F.transform(innermost, lambda ring: F.trim(ring))


def extract_pairs(text: Column) -> Column:
    """All bracketed coordinate pairs in a text, brackets removed."""
    return F.regexp_extract_all(text, F.lit(PAIR_PATTERN), F.lit(1))


def pairs_to_records(pairs: Column, first: str = "lat", second: str = "lng") -> Column:
    def record(pair: Column) -> Column:
        sides = F.split(pair, ", ?")
        return F.struct(
            F.element_at(sides, 1).cast("double").alias(first),
            F.element_at(sides, 2).cast("double").alias(second),
        )

    return F.transform(pairs, record)


def thousands(value: Column) -> Column:
    """No decimals, comma groups, half-even."""
    return F.format_number(value, 0)


def whole(value: Column) -> Column:
    """No decimals, no groups, half-even."""
    return F.bround(value, 0).cast("bigint").cast("string")


def title_case(value: Column) -> Column:
    """Underscores become spaces; of every run of letters the first is a capital, the others are small."""
    runs = F.regexp_extract_all(F.replace(value, F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")
