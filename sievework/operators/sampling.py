"""Sampling, splitting and capping with exact counts; every random choice is a hash of a seed and the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(key: str, seed: int = 0) -> Column:
    """A fixed random order of the keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def per_stratum(rows: DataFrame, by: list[str], key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` rows of each stratum, uniformly; Spark keeps only `cap` candidates of a partition."""
    return ranked(rows, by, [hash_order(key, seed), key]).where(F.col("place") <= cap).drop("place")


def round_robin(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows: one of each bucket in bucket order, then the second ones, and so on.

    No bucket gives more than n, so only the first n of each are ranked on.
    """
    near = ranked(rows, [by], [hash_order(key, seed), key]).where(F.col("place") <= n)
    return near.orderBy("place", by).limit(n).drop("place")


def interleaved(rows: DataFrame, by: str, order: list, position: str = "at") -> DataFrame:
    """Adds position: the i-th of each bucket come together, in bucket order, from 0, without a global sort in one task.

    The position of place p of a bucket is the sum over buckets of min(their size, p - 1), plus those before it that have
    a p-th row; bucket sizes are a small table. Places come from counted cells of the first order column, so no task holds a
    bucket.
    """
    sized = places(rows, [by], order[0], order[1:], "_p")
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    sizes = counts.agg(F.array_sort(F.collect_list(F.struct(by, "_n"))).alias("_sizes"))
    p = F.col("_p")
    full = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + F.least(x["_n"], (p - 1).cast("long")))
    earlier = F.size(F.filter("_sizes", lambda x: (x[by] < F.col(by)) & (x["_n"] >= p)))
    return sized.crossJoin(F.broadcast(sizes)).withColumn(position, full + earlier).drop("_p", "_sizes")


def ratio_split(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds is_valid: exactly clamp(round(n * fraction), 1, n - 1) rows, none if there are fewer than two.

    The threshold comes from counts of hash prefixes, then of the one prefix that straddles it: no global sort.
    """
    marked = rows.withColumn("_h", hash_order(key, seed)).withColumn("_cell", F.substring("_h", 1, 3))
    cells = {r["_cell"]: r["n"] for r in marked.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # at most 4096
    n = sum(cells.values())
    half_even = round(n * fraction)
    want = 0 if n < 2 else min(max(half_even, 1), n - 1)
    below, straddling = 0, None
    for cell in sorted(cells):
        if below + cells[cell] > want:
            straddling = cell
            break
        below += cells[cell]
    inside = F.col("_cell") < F.lit(straddling if straddling is not None else "g")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", key))
    edge = marked.where(F.col("_cell") == F.lit(straddling)).withColumn("_place", place).withColumn("is_valid", F.col("_place") <= want - below).drop("_place")
    rest = marked.where(~F.col("_cell").eqNullSafe(F.lit(straddling))).withColumn("is_valid", inside)
    return rest.unionByName(edge).drop("_h", "_cell")


def hash_limit(keys: DataFrame, key: str, want: int | None, fraction: float = 0.0, seed: int = 0, near: int = 10_000) -> tuple[str, int]:
    """(limit, n): the distinct keys whose hash_order is at or below the limit are exactly `want` (or max(1, int(n *
    fraction)) where want is None); n is how many keys there are.

    Counts of hash prefixes find the prefix that the limit lies in, longer prefixes narrow it until it holds at most
    `near` keys, and those are looked at: nothing that grows with the table comes to the driver.
    """
    marked = keys.select(hash_order(key, seed).alias("h"))
    prefix, below, n = "", 0, None
    while True:
        digits = len(prefix) + 3
        cells = {r.cell: r.n for r in marked.where(F.startswith("h", F.lit(prefix))).groupBy(F.substring("h", 1, digits).alias("cell")).agg(F.count("*").alias("n")).collect()}  # at most 4096
        if n is None:
            n = sum(cells.values())
            want = max(1, int(n * fraction)) if want is None else want
            if want <= 0 or not n:
                return "", n
            if want >= n:
                return "g", n
        for cell in sorted(cells):
            if below + cells[cell] >= want:
                break
            below += cells[cell]
        prefix = cell
        if cells[cell] <= near:
            found = sorted(r.h for r in marked.where(F.startswith("h", F.lit(prefix))).collect())
            return found[want - below - 1], n


def group_split(rows: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds is_valid so that no group straddles: max(1, int(n * fraction)) groups are valid. Null is a group.

    A group's hash decides against one limit, so rows are not shuffled.
    """
    limit, _ = hash_limit(rows.select(group).distinct(), group, None, fraction, seed)
    return rows.withColumn("is_valid", hash_order(group, seed) <= F.lit(limit))


def value_cells(rows: DataFrame, order: str, cells: int = 256, per_cell: int = 16) -> Column:
    """The cell of each row: how many of at most `cells` sampled values of the order are at or below it."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64(order), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * cells * per_cell / max(n, 1))) + 1) if n > cells * per_cell else rows
    values = sorted(r[0] for r in some.select(order).where(F.col(order).isNotNull()).distinct().limit(4 * cells * per_cell).collect())
    edges = sorted({values[i * len(values) // cells] for i in range(1, cells)}) if values else []
    if not edges:
        return F.lit(0)
    return F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order))))


def places(rows: DataFrame, by: list[str], order: str, ties: list[str], name: str, cell: Column | None = None) -> DataFrame:
    """Adds name: the place, from 1, by order within each group, without a group in one task: rows are ranked in cells of
    the order, and counts of cells (a small table) say where each cell begins. Without a `cell`, values are sampled for it."""
    marked = rows.withColumn("_cell", value_cells(rows, order) if cell is None else cell)
    counts = marked.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_cell") == F.col("_c")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    ranked_ = marked.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(order, *ties)))
    return ranked_.join(bases, same).withColumn(name, F.col("_base") + F.col("_inside")).drop("_cell", "_inside", "_c", "_base", *[f"_b{i}" for i in range(len(by))])


def stratified_split(rows: DataFrame, by: list[str], key: str, fraction: Column, seed: int = 0) -> DataFrame:
    """Adds is_first: of each cell greatest(1, least(bround(fraction * n), n - 1)) rows, or bround(fraction * n) of a cell of one."""
    cell = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")  # at most 4096 of a stratum
    marked = places(rows.withColumn("_h", hash_order(key, seed)), by, "_h", [key], "_p", cell)
    sizes = rows.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    take = F.bround(fraction * F.col("_n"), 0)
    quota = F.when(F.col("_n") >= 2, F.greatest(F.lit(1.0), F.least(take, F.col("_n") - 1.0))).otherwise(take)
    out = marked.join(sizes, same).withColumn("is_first", F.col("_p") <= quota)
    return out.drop("_n", "_p", "_h", *[f"_b{i}" for i in range(len(by))])


def capped_then_filled(rows: DataFrame, cell: list[str], order: str, cap: int, target: int) -> DataFrame:
    """Up to cap rows of each cell, then, to the target, the next ones by order whatever their cell. The order tells rows apart."""
    first = ranked(rows, cell, [order], "_p").where(F.col("_p") <= cap).drop("_p").orderBy(order).limit(target)
    # Of the others only the first `target` by order can be wanted, and of a cell's first rows at most `cap` stand before them.
    rest = rows.join(first.select(order), order, "left_anti").orderBy(order).limit(target).withColumn("_over", F.lit(1))
    return first.withColumn("_over", F.lit(0)).unionByName(rest).orderBy("_over", order).limit(target).drop("_over")


def prioritised(rows: DataFrame, by: list[str], key: str, first: Column, most: int, others: int, seed: int = 0) -> DataFrame:
    """A larger quota for strata of the priority set."""
    return ranked(rows, by, [hash_order(key, seed), key], "_p").where(F.col("_p") <= F.when(first, most).otherwise(others)).drop("_p")


def anonymised(rows: DataFrame, item: str, member: str, seed: int) -> DataFrame:
    """Adds label: A, B, ... in an order of the item's members that a hash fixes."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string"), F.col(member).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(item).orderBy(order, member))
    return rows.withColumn("label", F.char(F.lit(64) + place))
