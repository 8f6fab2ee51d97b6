"""Running computations over a total order, in parallel, for orders whose groups may hold most of all rows.

A window per group would put a hot group into one task. Here the rows are range-partitioned by group and order, which splits
hot groups, and are written down so that the limits, which come from a sample, stay as they are. Each part is computed on its
own; what earlier parts of the same group contribute is carried over. At most one group of a part began in an earlier one, so
the carried rows are no more than the parts and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

_AGG = {
    "sum": lambda c: F.sum(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.count(c),
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _both(kind: str, carry: Column, own: Column) -> Column:
    if kind == "max":
        return F.greatest(carry, own)
    if kind == "last":
        return F.coalesce(own, carry)
    if kind == "first":
        return F.coalesce(carry, own)
    return F.coalesce(carry + own, own, carry)


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, group: list[str], order: list[str | Column], values: dict[str, tuple[str, str]], inclusive: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with running values: ``values`` maps a new column to (kind, column), kind of ``_AGG``.

    A row's value is over the rows of its group before it, with it when ``inclusive``; null when there is none (counts: 0).
    ``order`` must be total within a group, or rows that tie must be alike. Nulls in ``group`` form a group.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    flat = df.repartitionByRange(_parts(df, parts), *(F.col(g) for g in group), *order)
    flat = materialize(flat.withColumn("_part", F.spark_partition_id()), "ordered")
    own = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    split = flat
    if group:
        # only the first group of a part can have begun in an earlier one
        firsts = flat.groupBy("_part").agg(F.min(F.struct(*group)).alias("g")).select(*(F.col("g")[g].alias(f"_f{i}") for i, g in enumerate(group))).distinct()
        on = F.lit(True)
        for i, g in enumerate(group):
            on = on & F.col(g).eqNullSafe(F.col(f"_f{i}"))
        split = flat.join(F.broadcast(firsts), on, "left_semi")
    # of each part and group what the whole part contributes to later ones
    over = {"sum": F.sum, "max": F.max, "count": F.count}
    whole = []
    for name, (kind, c) in values.items():
        if kind in over:
            whole.append(over[kind](c).alias(name))
        else:
            ranked = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            split = split.withColumn(f"_{name}_end", _AGG[kind](c).over(ranked))
            whole.append(F.first(f"_{name}_end").alias(name))
    ends = split.groupBy("_part", *group).agg(*whole, F.lit(1).alias("_here"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    fold = {"count": "sum"}
    carry = ends.select(
        F.col("_part").alias("_p"),
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
        F.sum("_here").over(earlier).alias("_before"),
        *(_AGG[fold.get(kind, kind)](name).over(earlier).alias(f"_{name}_carry") for name, (kind, _) in values.items()),
    ).where("_before > 0")
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = flat.join(F.broadcast(carry), on, "left")
    new = [_both(kind, F.col(f"_{name}_carry"), _AGG[kind](c).over(own)).alias(name) for name, (kind, c) in values.items()]
    return out.select(*df.columns, *new)


#: Bits of a generated number that count the rows of its partition.
_ROW_BITS = 33


def numbered(df: DataFrame, order: list[str | Column], name: str = "row_no", parts: int | None = None, keep: list[str | Column] | None = None) -> DataFrame:
    """``df``, or the columns ``keep`` of it, with row numbers from 1 in a total order, without gathering the rows.

    One shuffle: the parts are sorted, and a row's place in its part is the generated number's lower bits; what is written
    down is only ``keep``. The rows of the parts before are one number for each part.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    flat = df.repartitionByRange(_parts(df, parts), *order).sortWithinPartitions(*order)
    flat = flat.select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("_id"))
    columns = flat.columns[:-1]
    flat = materialize(flat, "numbered")
    part, row = F.shiftright("_id", _ROW_BITS), F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = flat.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return flat.join(F.broadcast(starts), part == F.col("_part")).select(*columns, (F.col("_start") + row + 1).alias(name))
