"""Sequential quotas over several tags, by deferred acceptance: each row in order takes its first tag that has quota left.

All tags prefer rows by the same order, so what the sequential rule gives is the one stable assignment, and that can be
found in rounds. A tag has a cut: it takes no row after it. In a round each row asks its first tag whose cut it is not
after; a tag that is asked by more rows than its quota lowers its cut to the last row it has room for. Cuts only fall, and
the tag that is filled first in order has its final cut after the first round, the next one after the second, so there are
at most as many rounds as tags. Nothing but counts leaves the tasks: a cut is found by counting the rows that ask in ever
narrower cells of the order.

Defined cases: rows without a known tag, or a null list, take none; a quota of 0 takes none; tags repeated in a row count
once; the order column is a whole number that tells rows apart, and rows where it is null take none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.sources.shared import written

#: Cells that the range of a cut is divided into in a pass.
CELLS = 1024
LAST = (1 << 63) - 1


def _asked(tags: Column, order: Column, cuts: dict[str, int]) -> Column:
    """The first of a row's tags whose cut the row is not after."""
    table = F.create_map(*[x for t, c in cuts.items() for x in (F.lit(t), F.lit(c).cast("long"))])
    return F.get(F.filter(tags, lambda t: order <= F.element_at(table, t)), F.lit(0))


def _cuts(asking: DataFrame, wanted: dict[str, int], bounds: dict[str, tuple[int, int]]) -> dict[str, int]:
    """The wanted-th smallest order of the rows (order, tag) of each tag. What is collected is CELLS numbers for each tag."""
    low, high, left = {t: bounds[t][0] for t in wanted}, {t: bounds[t][1] for t in wanted}, dict(wanted)
    while open_ := [t for t in wanted if low[t] < high[t]]:
        width = {t: -(-(high[t] - low[t] + 1) // CELLS) for t in open_}
        of = lambda table: F.element_at(F.create_map(*[x for t in open_ for x in (F.lit(t), F.lit(table[t]).cast("long"))]), F.col("tag"))  # noqa: E731, B023
        inside = asking.where(F.col("tag").isin(open_) & F.col("order").between(of(low), of(high)))
        counts = inside.groupBy("tag", F.floor((F.col("order") - of(low)) / of(width)).alias("cell")).agg(F.count("*").alias("n")).collect()
        for t in open_:
            for cell, n in sorted((r.cell, r.n) for r in counts if r.tag == t):
                if left[t] <= n:
                    high[t] = min(high[t], low[t] + (cell + 1) * width[t] - 1)
                    low[t] = low[t] + cell * width[t]
                    break
                left[t] -= n
    return low


def greedy_quota(rows: DataFrame, tags: str, order: str, quotas: dict[str, int]) -> DataFrame:
    """(order, tag) of the rows that a tag takes."""
    known = F.array(*map(F.lit, quotas))
    base = rows.select(F.col(order).cast("long").alias("order"), F.array_intersect(F.col(tags), known).alias("tags"))
    base = written(base.where(F.col("order").isNotNull() & (F.size("tags") > 0)), "quota")
    cuts = {t: LAST if q > 0 else -LAST - 1 for t, q in quotas.items()}
    while True:
        asking = base.select("order", _asked(F.col("tags"), F.col("order"), cuts).alias("tag")).where(F.col("tag").isNotNull())
        seen = asking.groupBy("tag").agg(F.count("*").alias("n"), F.min("order").alias("low"), F.max("order").alias("high")).collect()
        over = {r.tag: (r.low, r.high) for r in seen if r.n > quotas[r.tag]}
        if not over:
            return asking.select(F.col("order").cast(rows.schema[order].dataType).alias(order), "tag")
        cuts |= _cuts(asking, {t: quotas[t] for t in over}, over)
