"""Ordered computations over groups of any size.

A window over a whole group puts that group into one task.  Here a group is cut
into chunks that follow the row order (``chunk`` columns are monotone in
``order``): every chunk is windowed on its own, chunk summaries are folded per
group, and the carried-in value is joined back on ``keys + chunk``.  A group
holding a third of the table therefore spreads over as many tasks as it has
chunks, and only one summary row per chunk meets in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """Running aggregate of ``value`` up to and including the row.

    kind: ``sum`` | ``max`` | ``min`` | ``last`` (last non-null).
    ``before=True`` leaves the row itself out.
    """

    value: Column
    kind: str = "sum"
    before: bool = False


@dataclass(frozen=True)
class Shifted:
    """Value of the previous (``step=-1``) or next (``step=1``) row of the group."""

    value: Column
    step: int = -1


@dataclass(frozen=True)
class SinceReset:
    """Sum of ``value`` over the rows after the latest ``reset`` row (that row excluded).

    ``before=True`` gives the figure as it stood before the row.
    """

    value: Column
    reset: Column
    before: bool = False


@dataclass(frozen=True)
class Floored:
    """Running sum of ``value`` that never falls below zero (a queue length).

    ``before=True`` gives it as it stood before the row.
    """

    value: Column
    before: bool = False


def row_index() -> Running:
    """Zero-based position of the row inside its group."""
    return Running(F.lit(1).cast("long"), "sum", before=True)


_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return getattr(F, kind)(value).over(window)


def scan(df: DataFrame, keys: list[str], chunk: list[str], order: list, **specs) -> DataFrame:
    """Add one column per spec; ``keys`` and ``chunk`` columns must not be null."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    order_key = F.struct(*order_cols)
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order_cols)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    until = inside.rowsBetween(Window.unboundedPreceding, -1)
    groups = Window.partitionBy(*keys).orderBy(*chunk)
    earlier = groups.rowsBetween(Window.unboundedPreceding, -1)
    so_far = groups.rowsBetween(Window.unboundedPreceding, 0)

    local = df
    summary: list[Column] = []          # aggregates per chunk
    folded: list[tuple[str, Column]] = []  # columns over the chunk summaries, in order
    final: dict[str, Column] = {}
    from_rows = any(isinstance(s, (SinceReset, Floored)) for s in specs.values())
    if any(isinstance(s, Shifted) for s in specs.values()):
        local = local.withColumn("_first", F.row_number().over(inside) == 1)
        local = local.withColumn("_final", F.lead(F.lit(False), 1, True).over(inside))

    for name, spec in specs.items():
        loc, agg, car = f"_l_{name}", f"_s_{name}", f"_c_{name}"
        if isinstance(spec, Running):
            local = local.withColumn(loc, _over(spec.kind, spec.value, until if spec.before else upto))
            if spec.kind == "last":
                summary.append(F.max_by(spec.value, F.when(spec.value.isNotNull(), order_key)).alias(agg))
            else:
                summary.append(getattr(F, spec.kind)(spec.value).alias(agg))
            folded.append((car, _over(spec.kind, F.col(agg), earlier)))
            final[name] = _MERGE[spec.kind](F.col(car), F.col(loc))
        elif isinstance(spec, Shifted):
            back = spec.step < 0
            local = local.withColumn(loc, (F.lag if back else F.lead)(spec.value).over(inside))
            # a struct keeps a null edge value apart from "no neighbour"
            boxed = F.struct(spec.value.alias("v"))
            summary.append((F.max_by if back else F.min_by)(boxed, order_key).alias(agg))
            folded.append((car, (F.lag if back else F.lead)(F.col(f"{agg}.v")).over(groups)))
            final[name] = F.when(F.col("_first" if back else "_final"), F.col(car)).otherwise(F.col(loc))
        elif isinstance(spec, SinceReset):
            frame = until if spec.before else upto
            mark = F.coalesce(spec.reset, F.lit(False))
            local = local.withColumn(f"{loc}_all", F.coalesce(F.sum(spec.value).over(upto), F.lit(0)))
            at_reset = F.when(mark, F.col(f"{loc}_all"))
            upto_all = F.coalesce(F.sum(spec.value).over(frame), F.lit(0))
            local = local.withColumn(f"{loc}_base", F.last(at_reset, ignorenulls=True).over(frame))
            local = local.withColumn(loc, upto_all - F.coalesce(F.col(f"{loc}_base"), F.lit(0)))
            summary += [F.sum(spec.value).alias(f"{agg}_all"),
                        F.max_by(F.col(f"{loc}_all"), F.when(mark, order_key)).alias(f"{agg}_base")]
            folded.append((f"{car}_all", F.sum(F.col(f"{agg}_all")).over(so_far)))
            # total at the latest reset, counted from the start of the group
            folded.append((f"{car}_at", F.col(f"{car}_all") - F.col(f"{agg}_all") + F.col(f"{agg}_base")))
            folded.append((car, F.sum(F.col(f"{agg}_all")).over(earlier)
                           - F.coalesce(F.last(F.col(f"{car}_at"), ignorenulls=True).over(earlier), F.lit(0))))
            final[name] = F.when(F.col(f"{loc}_base").isNotNull(), F.col(loc)).otherwise(
                F.col(loc) + F.coalesce(F.col(car), F.lit(0)))
        else:  # Floored: S - min(0, running minimum of S)
            local = local.withColumn(f"{loc}_all", F.sum(spec.value).over(upto))
            frame = until if spec.before else upto
            local = local.withColumn(f"{loc}_min", F.coalesce(F.min(F.col(f"{loc}_all")).over(frame), F.lit(0)))
            local = local.withColumn(loc, F.coalesce(F.sum(spec.value).over(until), F.lit(0)) if spec.before else F.col(f"{loc}_all"))
            summary += [F.sum(spec.value).alias(agg), F.min(F.col(f"{loc}_all")).alias(f"{agg}_min")]
            folded.append((car, F.coalesce(F.sum(F.col(agg)).over(earlier), F.lit(0))))
            folded.append((f"{car}_low", F.min(F.col(car) + F.col(f"{agg}_min")).over(earlier)))
            total = F.col(car) + F.col(loc)
            low = F.least(F.lit(0), F.col(f"{car}_low"), F.col(car) + F.col(f"{loc}_min"))
            final[name] = total - low

    on = [*keys, *chunk]
    carry = (local if from_rows else df).groupBy(*on).agg(*summary)
    for name, value in folded:
        carry = carry.withColumn(name, value)
    joined = local.join(carry.select(*on, *[n for n, _ in folded]), on)
    kept = [c for c in df.columns if c not in specs]
    return joined.select(*kept, *[value.alias(name) for name, value in final.items()])


def top_by(df: DataFrame, keys: list[str], rank: Column, payload: list, largest: bool = True) -> DataFrame:
    """One row per group, chosen by a total ``rank``; combines map-side, so a hot
    group never meets in one task as rows."""
    pick = F.max_by if largest else F.min_by
    boxed = F.struct(*payload)
    return df.groupBy(*keys).agg(pick(boxed, rank).alias("_p")).select(*keys, "_p.*")


def with_halo(df: DataFrame, idx: str, size: int, before: int, after: int) -> DataFrame:
    """Cut dense ``idx`` into ``_chunk``s of ``size`` rows, each also holding the ``before``
    and ``after`` neighbours its rows look at; ``_core`` marks the chunk's own rows.

    Frames of a bounded width then need no window over the whole group.
    """
    i = F.col(idx)
    home = F.floor(i / size)
    first = F.greatest(F.floor((i - after) / size), F.lit(0))
    last = F.floor((i + before) / size)
    return (df.withColumn("_chunk", F.explode(F.sequence(first, last)))
            .withColumn("_core", F.col("_chunk") == home))
