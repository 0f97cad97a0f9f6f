"""Exact and approximate quantiles that never hold a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.session import written

SKETCH_ACCURACY = 10_000
# Bits of a value's key that each round tells apart, from the first on.
DIGITS = (18, 16, 15, 15)


def approx_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    *,
    by: Sequence[str] = (),
    extra: Sequence[Total] = (),
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One pass, mergeable sketches, relative rank error ``1/accuracy``."""
    sketch = F.percentile_approx(F.col(value).cast("double"), list(probs.values()), accuracy)
    picked = df.groupBy(*by).agg(sketch.alias("_q"), *(t.part() for t in extra))
    return picked.withColumns({name: F.col("_q")[i] for i, name in enumerate(probs)}).drop("_q")


class Total(NamedTuple):
    """An aggregate that is put together from parts: ``count`` (of all rows for ``*``), ``sum``, ``min`` or ``max``."""
    name: str
    kind: str
    column: str = "*"

    def part(self) -> Column:
        return getattr(F, self.kind)(self.column).alias(self.name)

    def whole(self) -> Column:
        again = F.sum if self.kind in ("count", "sum") else getattr(F, self.kind)
        merged = again(self.name)
        return (F.coalesce(merged, F.lit(0)) if self.kind == "count" else merged).alias(self.name)


def with_ordered_key(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a long for each double, in the same order: its sign, exponent and fraction bits. NaN comes last.

    The exponent is guessed from a logarithm and put right where that is rounded across a
    power of two; all other steps are exact. Steps are columns of their own, so that each is
    computed once a row.
    """
    own = [c for c in df.columns if c != name]
    guessed = df.select(*own, value.cast("double").alias("_v")).withColumn("_size", F.abs("_v")).withColumn(
        "_guess", F.least(F.greatest(F.floor(F.log2("_size")), F.lit(-1022)), F.lit(1023))).withColumn(
        "_fraction", F.col("_size") / F.pow(F.lit(2.0), F.col("_guess")))
    size, guess, fraction = F.col("_size"), F.col("_guess"), F.col("_fraction")
    up, down = fraction >= 2, (fraction < 1) & (guess > -1022)
    exponent = guess + F.when(up, 1).when(down, -1).otherwise(0)
    exact = F.when(up, fraction / 2).when(down, fraction * 2).otherwise(fraction)
    steps = (exact * F.lit(2.0**52)).cast("long") + (exponent + 1022) * F.lit(1 << 52)
    # Zero has no logarithm; the finite sizes come first because most values are.
    known = (F.when((size > 0) & (size < math.inf), steps).when(size == 0, F.lit(0).cast("long"))
             .when(F.isnan(size), F.lit((2047 << 52) + 1)).when(size == math.inf, F.lit(2047 << 52)))
    return guessed.withColumn("_known", known).select(
        *own, F.when(F.col("_v") < 0, -F.col("_known")).otherwise(F.col("_known")).alias(name))


def key_value(key: Column) -> Column:
    """The double that ``with_ordered_key`` made a key of."""
    size = F.abs(key)
    field, steps = F.shiftright(size, 52), size.bitwiseAND((1 << 52) - 1).cast("double")
    known = (F.when(field == 0, steps * F.lit(2.0**-1074))
             .when(field == 2047, F.when(steps == 0, F.lit(math.inf)).otherwise(F.lit(math.nan)))
             .otherwise((1 + steps / F.lit(2.0**52)) * F.pow(F.lit(2.0), field - 1023)))
    return F.when(key < 0, -known).otherwise(known)


def _holding(counts: Column, rank: Column) -> Column:
    """The part in which the wanted rank lies, and the rank within it; ``counts`` is sorted by part."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("part"),
                     F.lit(0).cast("long").alias("need"))

    def step(state: Column, entry: Column) -> Column:
        upto = state["upto"] + entry["c"]
        here = state["part"].isNull() & (upto >= rank)
        return F.struct(upto.alias("upto"), F.when(here, entry["part"]).otherwise(state["part"]).alias("part"),
                        F.when(here, rank - state["upto"]).otherwise(state["need"]).alias("need"))

    return F.aggregate(counts, start, step)


def _same(columns: Sequence[str]) -> Column:
    """Equal groups, null like any other, where the right side's columns are called ``_by_``."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return condition


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    *,
    by: Sequence[str] = (),
    extra: Sequence[Total] = (),
    linear: bool = False,
    bounded_groups: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``.

    ``linear=False`` picks an element (discrete rule), ``linear=True``
    interpolates between neighbours. ``extra`` adds aggregates of the same groups.

    Selection by radix: values are longs in the same order, and counts of their leading bits
    tell which leading bits hold a wanted rank. Only rows with these bits are counted by
    the next ones, until all 64 are known. The first digit has 18 bits, a sixty-fourth of
    an exponent, so the second scan keeps a per cent or so of the usual group, as
    counts of its distinct values; the other digits are taken from that table. Rows are
    counted before each shuffle and dealt by group and digit; what one row holds of a group is
    at most 2^18 counts (4 MB), whatever the group's size and however its values lie.

    ``bounded_groups`` says the number of groups is bounded by their meaning
    (calendar months, one global group) and may be broadcast; otherwise the
    engine picks the join by size. With ``weight`` a row stands for that many equal ones;
    ``extra`` still sees it once.
    """
    keys = list(by) or ["_one"]
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df if by else df.withColumn("_one", F.lit(0))
    keyed = with_ordered_key(rows, F.col(value), "_key")
    first = 64 - DIGITS[0]
    digits = written(keyed.groupBy(*keys, F.shiftright("_key", first).alias("_part")).agg(
        F.sum(F.when(F.col("_key").isNotNull(), times).otherwise(0)).alias("_c"), *(t.part() for t in extra)), "digits")
    totals = [F.sum("_c").alias("_n"), *(t.whole() for t in extra)]
    groups = digits.groupBy(*keys).agg(*totals) if by else digits.agg(*totals).withColumn("_one", F.lit(0))

    ranks: list[tuple[str, Column]] = []
    for name, p in probs.items():
        if linear:
            position = (F.col("_n") - 1) * F.lit(p)
            ranks += [(f"{name}_lo", F.floor(position) + 1), (f"{name}_hi", F.ceil(position) + 1)]
        else:
            ranks.append((name, F.greatest(F.ceil(F.col("_n") * F.lit(p)), F.lit(1))))

    def side(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if bounded_groups or not by else table

    def sorted_counts(counts: DataFrame, columns: list[str]) -> DataFrame:
        return counts.groupBy(*columns).agg(
            F.sort_array(F.collect_list(F.struct(F.col("_part").alias("part"), F.col("_c").alias("c")))).alias("_counts"),
            F.sum("_c").alias("_n"), *([F.first("_need").alias("_need")] if "_id" in columns else []))

    def narrowed(counted: DataFrame, wanted: Column, columns: list[str]) -> DataFrame:
        found = counted.withColumn("_found", _holding(F.col("_counts"), wanted))
        return found.select(*columns, F.col("_found.part").alias("_held"), F.col("_found.need").alias("_need"))

    known = sorted_counts(digits.where("_c > 0"), keys).select("*", F.explode(F.array(*(
        F.struct(F.lit(t).alias("id"), rank.cast("long").alias("rank")) for t, (_, rank) in enumerate(ranks)))).alias("_t"))
    targets = written(narrowed(known.withColumn("_id", F.col("_t.id")), F.col("_t.rank"), [*keys, "_id"]), "targets")

    # The leading bits as a range of values, which needs no key of the rows that it rules out.
    start = F.shiftleft("_held", first)
    asked = targets.select(*(F.col(c).alias(f"_by_{c}") for c in keys), key_value(start).alias("_low"),
                           key_value(start + ((1 << first) - 1)).alias("_high")).distinct()
    within = rows.select(*keys, F.col(value).cast("double").alias("_value"), times.alias("_times")).join(
        side(asked), _same(keys) & F.col("_value").between(F.col("_low"), F.col("_high")))
    candidates = written(with_ordered_key(
        within.groupBy(*keys, "_value").agg(F.sum("_times").alias("_c")), F.col("_value"), "_key").drop("_value"), "candidates")
    left = first
    for bits in DIGITS[1:]:
        wanted = targets.withColumnsRenamed({c: f"_by_{c}" for c in keys})
        inside = candidates.join(side(wanted), _same(keys) & (F.shiftright("_key", left) == F.col("_held")))
        left -= bits
        counts = inside.groupBy(*keys, "_id", "_need", F.shiftright("_key", left).alias("_part")).agg(F.sum("_c").alias("_c"))
        targets = narrowed(sorted_counts(counts, [*keys, "_id"]), F.col("_need"), [*keys, "_id"])
    chosen = targets.groupBy(*keys).agg(*(
        F.max(F.when(F.col("_id") == t, F.col("_held"))).alias(name) for t, (name, _) in enumerate(ranks)))
    chosen = chosen.withColumnsRenamed({c: f"_by_{c}" for c in keys})
    result = groups.join(side(chosen), _same(keys), "left").withColumns(
        {name: key_value(F.col(name)) for name, _ in ranks}).drop(*(f"_by_{c}" for c in keys), "_one")
    if linear:
        for name, p in probs.items():
            position = (F.col("_n") - 1) * F.lit(p)
            low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
            # Equal neighbours need no step; between infinite ones there is none.
            result = result.withColumn(name, F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position))))
        result = result.drop(*(name for name, _ in ranks))
    return result.drop("_n")


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], *, exact: bool, **options) -> DataFrame:
    if exact:
        return exact_quantiles(df, value, probs, **options)
    options.pop("bounded_groups", None)
    options.pop("linear", None)
    return approx_quantiles(df, value, probs, **options)
