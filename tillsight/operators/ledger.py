"""Ledger views: sort by any column, dense positions, paging, set ops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..schema import LEDGER_PAGE_SIZE
from ..session import stored


EARLY_ROWS = 10_000   # ledger rows per tenant that a group limit keeps in one window


def sort_key(df: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """L4: text sorts case-insensitively with null as ''; numbers numerically.
    Ties break on ``id``, then on every other column (ids of different rows
    may repeat), so the order is total over distinct rows."""
    dt = df.schema[column].dataType
    key = (F.lower(F.coalesce(F.col(column), F.lit(""))) if isinstance(dt, T.StringType)
           else F.col(column))
    key = key.asc_nulls_first() if ascending else key.desc_nulls_last()
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c not in ("id",)]
    return [key, F.col("id").asc_nulls_first(), *rest]


def with_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Dense 1-based position of every row in a total order, without a
    single-partition window.

    The rows are range-partitioned and sorted, tagged with their partition
    id and in-partition offset, and stored with these tags as a compressed table, so
    that both passes below see the same partitioning. Per-partition
    counts (one row per partition, a bounded table) give each partition its
    starting offset.
    """
    sorted_ = (df.orderBy(*order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = stored(sorted_, "sorted")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn(
        "_start", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(F.broadcast(starts.select("_pid", "_start")), "_pid")
            .withColumn(name, F.col("_start") + local + 1)
            .drop("_pid", "_mid", "_start"))


def positions_by(df: DataFrame, by: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """Dense 1-based position within each ``by`` group (e.g. per tenant).

    One global distributed sort on (group, order); each group's first global
    position comes from a one-row-per-group aggregate joined back, so a
    tenant holding a third of the rows is still spread over many tasks."""
    if not by:
        return with_positions(df, order, name)
    g = with_positions(df, [*[F.col(b).asc() for b in by], *order], "_gpos")
    first = g.groupBy(*by).agg(F.min("_gpos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (g.join(F.broadcast(first), by).withColumn(name, F.col("_gpos") - F.col("_first") + 1)
            .drop("_gpos", "_first"))


def ledger_sorted(df: DataFrame, column: str, ascending: bool = True, by=("user_id",)) -> DataFrame:
    """L4 for every tenant's ledger at once: position of each row."""
    by = [b for b in by if b in df.columns]
    return positions_by(df, by, sort_key(df, column, ascending)).drop("_n")


def ledger_page(df: DataFrame, column: str, ascending: bool = True, page: int = 1,
                page_size: int = LEDGER_PAGE_SIZE, by=("user_id",)) -> DataFrame:
    """Page ``page`` of every tenant's sorted ledger; a page past the
    end shows the last page. Adds the ``x to y of n`` caption.

    Pages among the first ``EARLY_ROWS`` rows come from a ranking that every
    task cuts to those rows before the shuffle (a group limit), plus a count
    per tenant. Later pages take positions from a distributed sort, so they
    all cost the same. Both give the same page."""
    by = [b for b in by if b in df.columns]
    order = sort_key(df, column, ascending)
    if by and page * page_size <= EARLY_ROWS:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        first = df.withColumn("pos", rank).where(F.col("pos") <= page * page_size)
        pos = first.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    else:
        pos = positions_by(df, by, order)
    if not by:
        pos = pos.crossJoin(F.broadcast(pos.agg(F.count(F.lit(1)).alias("_n"))))   # one row
    pages = F.greatest(F.ceil(F.col("_n") / F.lit(page_size)), F.lit(1))
    cur = F.least(F.lit(page), pages)
    lo, hi = (cur - 1) * page_size + 1, cur * page_size
    out = pos.where((F.col("pos") >= lo) & (F.col("pos") <= hi))
    caption = F.format_string("%d to %d of %d", lo, F.least(hi, F.col("_n")), F.col("_n"))
    return out.withColumn("caption", caption).drop("_n")


DISTINCT_DIMS = [("category", "category"), ("region", "region"),
                 ("product", "product_name"), ("customer", "customer_id")]


def distinct_dims(df: DataFrame, dims=DISTINCT_DIMS, by=("user_id",)) -> DataFrame:
    """Distinct non-null values per dimension and tenant (long form)."""
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(c).cast("string").alias("value")) for d, c in dims]))
        .alias("o")).select(*by, "o.dim", "o.value")
    return long.where(F.col("value").isNotNull()).distinct()


def union_datasets(frames: list[DataFrame]) -> DataFrame:
    """All uploads of a tenant together; columns missing in one upload are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def running_totals(df: DataFrame, by: list[str], order: list[Column], value: str,
                   rank: str = "rank", total: str = "cum") -> DataFrame:
    """Rank and running sum of ``value`` within each ``by`` group, in
    ``order``, without a window that holds a whole group.

    One distributed range sort on (group, order); each partition computes
    its local running count and sum per group, and a table with one row per
    (partition, group) supplies the totals of the earlier partitions."""
    sorted_ = (df.orderBy(*[F.col(b).asc() for b in by], *order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = stored(sorted_, "sorted")
    w_local = Window.partitionBy("_pid", *by).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = (tagged.withColumn("_lc", F.count(F.lit(1)).over(w_local))
             .withColumn("_ls", F.sum(value).over(w_local)))
    parts = tagged.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_pc"), F.sum(value).alias("_ps"))
    w_prev = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_pid", *by, F.coalesce(F.sum("_pc").over(w_prev), F.lit(0)).alias("_oc"),
                        F.sum("_ps").over(w_prev).alias("_os"))
    out = local.join(offs, ["_pid", *by])
    return (out.withColumn(rank, (F.col("_oc") + F.col("_lc")).cast("bigint"))
            .withColumn(total, F.coalesce(F.col("_os") + F.col("_ls"), F.col("_ls")))
            .drop("_pid", "_mid", "_lc", "_ls", "_oc", "_os"))
