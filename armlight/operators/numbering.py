"""Row numbers over a whole table without putting it into one partition."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.sources.files import stage

_SLOT_MASK = (1 << 33) - 1


def number_rows(
    df: DataFrame, order_by, name: str, start: int = 1, total: str | None = None, drop=()
) -> DataFrame:
    """``row_number() over (order by ...)`` as a range sort plus offsets.

    ``order_by`` must be a total order. Rows are range partitioned on it, so a
    value shared by many rows is split by the later sort columns. The slot of a
    row inside its partition is fixed by writing the table once. The driver reads
    only the partition sizes, one number per partition; the returned frame is a
    scan with an addition. The input is read twice, for the range bounds and for
    the sort, so it should be narrow. Sort columns named in ``drop`` are not written.
    """
    laid_out = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .drop(*drop)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_slot": F.monotonically_increasing_id().bitwiseAND(F.lit(_SLOT_MASK)),
            }
        )
    )
    table = stage(laid_out, f"numbered-{name}")
    sizes = dict(table.groupBy("_part").agg(F.count(F.lit(1))).collect())
    before = [start]
    for part in range(max(sizes, default=0) + 1):
        before.append(before[-1] + sizes.get(part, 0))
    starts = ", ".join(f"{b}L" for b in before[:-1])
    columns = [F.col(c) for c in df.columns if c not in drop]
    columns.append(F.expr(f"_slot + element_at(array({starts}), _part + 1)").alias(name))
    if total:
        columns.append(F.lit(before[-1] - start).cast("bigint").alias(total))
    return table.select(*columns)


def in_batches(position, size: int, start: int = 1):
    """Zero-based batch number of a row position."""
    return F.expr(f"(`{position}` - {start}) div {size}")
