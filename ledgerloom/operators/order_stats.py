"""Global order statistics without a global task: selected ranks, positions and running sums.

Selected ranks need no sort: samples bracket them, exact counts place the brackets, and only what lies inside is ranked.
Positions and running sums sort by range partitioning, write the sorted rows once to the shared staging area, and add
per-partition offsets, which are at most one row per partition (and key).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import as_col
from ..session import stage, staged

#: One key of an order: column, whether NULLs come first and, optionally, whether it descends.
Key = tuple[str, bool] | tuple[str, bool, bool]

#: Keys that a sample of one bracket has (about), and rows that one task may rank at the end.
SAMPLE, RANKED = 20_000, 50_000
#: Sorted rows in a range partition, beyond which there are more partitions than the session's setting.
RANGE_ROWS = 2_000_000
#: monotonically_increasing_id() keeps the partition above this many bits of row number.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def _parts(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def _sorted(df: DataFrame, order: Sequence[Column], parts: int) -> DataFrame:
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _slice(at: str = "_at") -> Column:
    return F.shiftrightunsigned(F.col(at), _ROW_BITS)


# ------------------------------------------------------------------------ selected ranks
def _descends(key: Key) -> bool:
    return len(key) > 2 and key[2]


def _sort_column(key: Key) -> Column:
    name, nulls_first = key[0], key[1]
    if _descends(key):
        return F.desc_nulls_first(name) if nulls_first else F.desc_nulls_last(name)
    return F.asc_nulls_first(name) if nulls_first else F.asc_nulls_last(name)


def _after(row: Row, order: Sequence[Key]) -> Column:
    """True for rows that sort strictly after ``row``."""
    key, rest = order[0], order[1:]
    nulls_first, here, mark = key[1], F.col(key[0]), row[key[0]]
    if mark is None:
        beyond, same = (here.isNotNull() if nulls_first else F.lit(False)), here.isNull()
    else:
        beyond = F.coalesce(here < F.lit(mark) if _descends(key) else here > F.lit(mark), F.lit(not nulls_first))
        same = F.coalesce(here == F.lit(mark), F.lit(False))
    return beyond | (same & _after(row, rest)) if rest else beyond


def _in_order(rows: list[Row], order: Sequence[Key]) -> list[Row]:
    """A sample in the order that Spark gives it: NaN is the largest number."""
    for key in reversed(order):
        name, last = key[0], _descends(key)
        present = sorted((r for r in rows if r[name] is not None), key=lambda r: (r[name] != r[name], 0 if r[name] != r[name] else r[name]), reverse=last)
        absent = [r for r in rows if r[name] is None]
        rows = absent + present if key[1] else present + absent
    return rows


@dataclass
class _Bracket:
    """The rows after ``low`` up to ``high`` (None: no bound): how many come before them and how many they are."""

    axis: int
    low: Row | None
    high: Row | None
    below: int
    inside: int
    ranks: list[int]

    def holds(self, order: Sequence[Key]) -> Column:
        bounds = ([_after(self.low, order)] if self.low is not None else []) + ([~_after(self.high, order)] if self.high is not None else [])
        return reduce(lambda a, b: a & b, bounds, F.lit(True))


def select_rows(
    df: DataFrame, axes: Sequence[tuple[Sequence[Key], Sequence[int]]], total: int | None = None, sample: int = SAMPLE, ranked: int = RANKED,
) -> list[dict[int, Row]]:
    """For each axis (order, 1-based ranks) the row at every rank; an order must end in a unique key.

    A uniform sample of the keys, chosen by their hash, brackets every rank of every axis at once; one aggregate then counts
    exactly what lies below and inside each bracket, so a bracket that missed its rank is moved, never trusted. Brackets narrow
    about a hundredfold in each round of two scans, and once they hold few rows, one task each ranks them. No row is
    sorted or moved but those, and the driver holds about ``sample`` keys for each bracket.
    """
    names = list(dict.fromkeys(key[0] for order, _ in axes for key in order))
    keys = df.select(*names)
    total = keys.count() if total is None else total
    for _, ranks in axes:
        missing = [r for r in ranks if not 1 <= r <= total]
        if missing:
            raise ValueError(f"ranks {missing} are outside 1..{total}")
    brackets = [_Bracket(i, None, None, 0, total, sorted(set(ranks))) for i, (_, ranks) in enumerate(axes) if ranks]
    while any(b.inside > ranked for b in brackets):
        brackets = [b for b in brackets if b.inside <= ranked] + _narrowed(keys, axes, [b for b in brackets if b.inside > ranked], sample)
    found: list[dict[int, Row]] = [{} for _ in axes]
    parts = []
    for i, (order, _) in enumerate(axes):
        mine = [(n, b) for n, b in enumerate(brackets) if b.axis == i]
        if not mine:
            continue
        tags = F.explode(F.array_compact(F.array(*[F.when(b.holds(order), F.lit(n)) for n, b in mine])))
        place = F.row_number().over(Window.partitionBy("_bracket").orderBy(*[_sort_column(k) for k in order]))
        wanted = reduce(lambda x, y: x | y, [(F.col("_bracket") == n) & F.col("_place").isin([r - b.below for r in b.ranks]) for n, b in mine])
        parts.append(keys.select("*", tags.alias("_bracket")).withColumn("_place", place).where(wanted))
    for row in reduce(DataFrame.unionByName, parts).collect() if parts else []:  # one row for each rank
        bracket = brackets[row["_bracket"]]
        found[bracket.axis][bracket.below + row["_place"]] = row
    return found


def _narrowed(keys: DataFrame, axes: Sequence[tuple[Sequence[Key], Sequence[int]]], brackets: list[_Bracket], sample: int) -> list[_Bracket]:
    """The brackets of single ranks inside ``brackets``, from one sample and one count of all rows."""
    bits, sample = 30, max(sample, 100)  # fewer keys would not narrow a bracket
    spread = F.pmod(F.xxhash64(*keys.columns, F.lit(len(brackets))), F.lit(1 << bits))
    regions: dict[tuple, list[int]] = {}  # axes that have not been bracketed yet share a sample
    for n, b in enumerate(brackets):
        regions.setdefault((None, None) if b.low is None and b.high is None else (b.axis, n), []).append(n)
    owners = list(regions.values())
    held = [brackets[own[0]].holds(axes[brackets[own[0]].axis][0]) for own in owners]
    chosen = [F.when(here & (spread < max(1, (sample << bits) // brackets[own[0]].inside)), F.lit(i)) for i, (own, here) in enumerate(zip(owners, held, strict=True))]
    drawn: list[list[Row]] = [[] for _ in owners]
    for row in keys.select("*", F.explode(F.array_compact(F.array(*chosen))).alias("_region")).collect():
        drawn[row["_region"]].append(row)
    guesses: list[tuple[_Bracket, int, Row | None, Row | None]] = []
    for own, rows in zip(owners, drawn, strict=True):
        for n in own:
            b = brackets[n]
            ordered = _in_order(rows, axes[b.axis][0])
            for rank in b.ranks:
                share = (rank - b.below) / b.inside
                middle, margin = share * len(ordered), 3 * math.sqrt(len(ordered) * share * (1 - share)) + 4
                first, last = math.floor(middle - margin), math.ceil(middle + margin)
                if len(ordered) == b.inside:  # every row was drawn, so the place is known
                    first, last = rank - b.below - 2, rank - b.below - 1
                guesses.append((b, rank, ordered[first] if first >= 0 else b.low, ordered[last] if last < len(ordered) else b.high))
    counts = []
    for i, (b, _, low, high) in enumerate(guesses):
        order = axes[b.axis][0]
        counts.append((F.count_if(~_after(low, order)) if low is not None else F.lit(0)).alias(f"below{i}"))
        counts.append((F.count_if(~_after(high, order)) if high is not None else F.count("*")).alias(f"upto{i}"))
    exact = keys.agg(*counts).first()
    out = []
    for i, (b, rank, low, high) in enumerate(guesses):
        below, upto = exact[f"below{i}"], exact[f"upto{i}"]
        if rank <= below:
            out.append(_Bracket(b.axis, b.low, low, b.below, below - b.below, [rank]))
        elif rank > upto:
            out.append(_Bracket(b.axis, high, b.high, upto, b.below + b.inside - upto, [rank]))
        else:
            out.append(_Bracket(b.axis, low, high, below, upto - below, [rank]))
    return out


def rows_at(df: DataFrame, order: Sequence[Key], ranks: Sequence[int], **sizes: int) -> list[Row]:
    """The rows at the given 1-based ranks of one total order."""
    found = select_rows(df, [(order, ranks)], **sizes)[0]
    return [found[rank] for rank in ranks]


def ntile_columns(df: DataFrame, axes: Sequence[tuple[Sequence[Key], int]], **sizes: int) -> list[Column]:
    """For each (order, k) a row-local expression equal to ``ntile(k)`` over that order.

    An order must end in a unique, non-NULL key. The k - 1 rows that close a bucket are found for all axes
    together; every row is then placed by comparing it with them, so the numbering needs no exchange of
    the frame it is applied to. ``df`` is read a few times; pass a stored table when it is large.
    """
    total = df.count()
    if total == 0:
        return [F.lit(1) for _ in axes]
    ends = []
    for order, k in axes:
        size, larger = divmod(total, k)
        # buckets beyond the rows are empty, and their ends fall together with the last row
        ends.append((order, [e for e in dict.fromkeys(j * size + min(j, larger) for j in range(1, k)) if e < total]))
    found = select_rows(df, ends, total, **sizes)
    return [reduce(lambda a, row: a + F.when(_after(row, order), 1).otherwise(0), [rows[r] for r in ranks], F.lit(1))
            for (order, ranks), rows in zip(ends, found, strict=True)]


def ntile_column(df: DataFrame, order: Sequence[Key], k: int, **sizes: int) -> Column:
    return ntile_columns(df, [(order, k)], **sizes)[0]


# ------------------------------------------------------------------------ positions and running sums
def with_position(df: DataFrame, order: Sequence[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row in the total order. ``order`` must be a unique key."""
    placed = _sorted(df, order, parts or _parts(df, df.count())).withColumn("_at", F.monotonically_increasing_id())
    table, _ = stage(placed, "positions")
    sizes = table.groupBy(_slice().alias("_slice")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sort: the broadcast is bounded by the partition count.
    return table.withColumn("_slice", _slice()).join(F.broadcast(starts), "_slice").withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(_ROW_MASK)) + 1).drop("_slice", "_start", "_at")


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], parts: int | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Adds ``<name>_upto``, the inclusive running sum of each whole-number column in ``sums``, for each key of ``by`` apart
    (NULL is a key). Keys lead the sort, so one sort serves any number of them, and a hot key spreads over partitions.

    Each sorted partition sums its own rows in one streaming pass that starts anew where the key changes. Only the first key of a
    partition can go on from partitions before it, and only the last can go on behind it: two rows for each partition
    carry what is added afterwards.
    """
    inner = [f"_{c}_here" for c in sums]
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.LongType()) for c in inner]
                          + [T.StructField("_slice", T.IntegerType()), T.StructField("_run", T.LongType())])
    names, out_names, keys = tuple(sums), tuple(inner), tuple(by)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as pc
        from pyspark import TaskContext

        def apart(column, before):
            """Where a value differs from the one before it, NULL being a value."""
            joined = arrow.concat_arrays([before, column]) if before is not None else column
            a, b = joined.slice(0, len(joined) - 1), joined.slice(1)
            known = pc.and_(pc.is_valid(a), pc.is_valid(b))
            other = pc.or_(pc.xor(pc.is_valid(a), pc.is_valid(b)), pc.and_(known, pc.fill_null(pc.not_equal(a, b), False)))
            found = other.to_numpy(zero_copy_only=False)
            return found if before is not None else np.concatenate(([False], found))

        piece, carried, run, last = TaskContext.get().partitionId(), [0] * len(names), 0, [None] * len(keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, bool)
            for i, key in enumerate(keys):
                starts |= apart(batch.column(key), last[i])
                last[i] = batch.column(key).slice(batch.num_rows - 1)
            heads = np.flatnonzero(starts)
            group = np.cumsum(starts)
            columns = list(batch.columns)
            for i, name in enumerate(names):
                own = pc.fill_null(batch.column(name).cast(arrow.int64()), 0).to_numpy()
                upto = np.cumsum(own)
                base = np.concatenate(([-carried[i]], upto[heads] - own[heads]))
                upto = upto - base[group]
                carried[i] = int(upto[-1])
                columns.append(arrow.array(upto))
            columns += [arrow.array(np.full(batch.num_rows, piece, np.int32)), arrow.array(run + group.astype(np.int64))]
            run += int(group[-1])
            yield arrow.RecordBatch.from_arrays(columns, names=list(batch.schema.names) + list(out_names) + ["_slice", "_run"])

    lead = [F.asc_nulls_first(k) for k in by]
    with staged(df, "unsorted") as source:
        table, _ = stage(_sorted(source, [*lead, *order], parts or _parts(source, source.count())).mapInArrow(accumulate, schema), "running")
    # runs between a partition's first (0) and last concern no other partition; broadcasts have one row per partition
    last = table.groupBy("_slice").agg(F.max("_run").alias("_last"))
    edge = table.join(F.broadcast(last), "_slice").where("_run = 0 OR _run = _last")
    ends = edge.groupBy("_slice", "_run", *by).agg(*[F.sum(name).alias(c + "_end") for name, c in zip(sums, inner)])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_slice", "_run", *[F.coalesce(F.sum(c + "_end").over(before), F.lit(0)).alias(c + "_start") for c in inner]).where("_run = 0")
    joined = table.join(F.broadcast(starts), ["_slice", "_run"], "left")
    return joined.select(*df.columns, *[
        (F.col(c) + F.coalesce(F.col(c + "_start"), F.lit(0))).alias(f"{name}_upto") for name, c in zip(sums, inner)])


def top_n(df: DataFrame, keys: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order; for report-sized ``n``, each task keeps only its own best."""
    return df.orderBy(*[as_col(k) for k in keys]).limit(n)
