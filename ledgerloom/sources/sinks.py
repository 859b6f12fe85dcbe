"""Writing tables and extracts, and proving that what was written is what was meant."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_path


def save_layer(df: DataFrame, layer: str, model: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> str:
    """Materialise a model as table ``layer.model``; facts are best partitioned by month."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}`")
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(f"`{layer}`.`{model}`")
    return f"{layer}.{model}"


def save_bucketed(df: DataFrame, layer: str, model: str, key: str, buckets: int) -> str:
    """Materialise with a bucketed key, so later joins and groupings on it need no exchange."""
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}`")
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"`{layer}`.`{model}`")
    return f"{layer}.{model}"


def save_fact(df: DataFrame, table: str, month: str, key: str, buckets: int) -> str:
    """Materialise a fact as a table partitioned by month and bucketed by key, one file for each month and bucket. Joins and
    groupings on the key need no exchange, a month can be replaced by itself, and a filter on months reads no other."""
    placed = df.select(*[c for c in df.columns if c != month], month).repartition(month, F.pmod(F.hash(key), F.lit(buckets)))
    placed.write.mode("overwrite").partitionBy(month).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return table


def replace_months(df: DataFrame, table: str, month: str, key: str, buckets: int, months: Sequence[str]) -> None:
    """Replaces the given months, each as one partition; all others keep their files. Rows of ``df`` outside them are left out."""
    spark = df.sparkSession
    columns = [c for c in spark.table(table).columns if c != month]
    for name in months:
        rows = df.where(F.col(month) == name).select(*columns).repartition(buckets, F.pmod(F.hash(key), F.lit(buckets)))
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({month} = :month) SELECT * FROM {{rows}}", {"month": name}, rows=rows)


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles in the plan of a frame, as the plan prints them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange " in line]


def save_checked(df: DataFrame, path: str, checks: Mapping[str, Column]) -> DataFrame:
    """Writes a fact and returns (check_name, value) of aggregates that were taken while it was written: no scan is
    spent on them. Values are whole numbers."""
    seen = Observation()
    df.observe(seen, *[value.cast("bigint").alias(name) for name, value in checks.items()]).write.mode("errorifexists").parquet(path)
    return df.sparkSession.createDataFrame([(name, seen.get[name]) for name in checks], "check_name string, value bigint")


def export_csv(df: DataFrame, path: str, order_by: Sequence[str | Column] = ()) -> None:
    """CSV with header; NULL is written as an empty field. With ``order_by`` the part files are
    range-partitioned and sorted, so reading them in name order gives the total order."""
    ordered = df.orderBy(*order_by) if order_by else df
    ordered.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option(
        "escape", '"').csv(path)


def export_facts(df: DataFrame, money: str) -> DataFrame:
    """The three facts a round trip must preserve: rows, NULLs and the money total in cents."""
    cents = F.sum(F.col(money).cast("decimal(28,2)"))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(money).isNull()).alias("n_null"),
        (cents * 100).cast("bigint").alias("cents"),
    )


def _sort_key(key: str | Column) -> tuple[str, bool]:
    """(column, descends) of a sort key; NULLs come first where it ascends and last where it descends, as Spark sorts."""
    if isinstance(key, str):
        return key, False
    words = key._jc.toString().split()
    return words[0], "DESC" in words


def files_in_order(rows: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """(n_blocks, n_rows, in_order) of a frame that reads files: whether the files, in name order, hold one total order.

    Each block of a file is checked as it streams by, neighbour against neighbour; what is left is its first and last
    key, one row for each block, and these are compared in the order of names and places.
    """
    keys = [_sort_key(k) for k in order_by]
    types = {f.name: f.dataType for f in rows.schema.fields}
    ends = [T.StructField(f"{side}{i}", types[name]) for side in ("first", "last") for i, (name, _) in enumerate(keys)]
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("sorted", T.BooleanType()), *ends])
    descends = [d for _, d in keys]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as pc

        def falls(columns):
            """Whether a row sorts before the one above it."""
            wrong, same = np.zeros(len(columns[0]) - 1, bool), np.ones(len(columns[0]) - 1, bool)
            for column, down in zip(columns, descends, strict=True):
                a, b = column.slice(0, len(column) - 1), column.slice(1)
                less = pc.fill_null(pc.greater(b, a) if down else pc.less(b, a), False).to_numpy(zero_copy_only=False)
                equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
                no_a, no_b = (pc.is_null(x).to_numpy(zero_copy_only=False) for x in (a, b))
                less |= (no_a & ~no_b) if down else (~no_a & no_b)
                wrong |= same & less
                same &= equal | (no_a & no_b)
            return wrong

        state = None  # file, place, rows, in order, first keys, last keys
        for batch in batches:
            if not batch.num_rows:
                continue
            names, places = batch.column("_file").to_pylist(), batch.column("_place").to_numpy()
            cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1] or places[i] != places[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                part = [batch.column(f"k{i}").slice(a, b - a) for i in range(len(descends))]
                if state is not None and (state[0], state[1]) != (names[a], places[a]):
                    yield given(state)
                    state = None
                if state is None:
                    state = [names[a], int(places[a]), 0, True, [p.slice(0, 1) for p in part], None]
                joined = part if state[5] is None else [arrow.concat_arrays([x, p]) for x, p in zip(state[5], part, strict=True)]
                state[3] = state[3] and not falls(joined).any()
                state[2] += b - a
                state[5] = [p.slice(b - a - 1) for p in part]
        if state is not None:
            yield given(state)

    def given(state) -> pa.RecordBatch:
        import pyarrow as arrow

        head = [arrow.array([state[0]]), arrow.array([state[1]], arrow.int64()), arrow.array([state[2]], arrow.int64()), arrow.array([state[3]])]
        return arrow.RecordBatch.from_arrays([*head, *state[4], *state[5]], names=[f.name for f in schema.fields])

    told = rows.select(F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_place"), *[F.col(n).alias(f"k{i}") for i, (n, _) in enumerate(keys)])
    blocks = told.mapInArrow(check, schema)
    before = Window.orderBy("file", "place")  # one row for each block of a file
    placed = blocks.select("*", *[F.lag(f"last{i}").over(before).alias(f"above{i}") for i in range(len(keys))], F.lag("n").over(before).alias("_above"))
    falls: Column = F.lit(False)
    for i, (_, down) in reversed(list(enumerate(keys))):
        a, b = F.col(f"above{i}"), F.col(f"first{i}")
        less = F.coalesce(b > a if down else b < a, (a.isNull() & b.isNotNull()) if down else (a.isNotNull() & b.isNull()))
        falls = less | (a.eqNullSafe(b) & falls)
    return placed.agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.bool_and(F.col("sorted") & ~(F.col("_above").isNotNull() & falls)), F.lit(True)).alias("in_order"))


def verified_export(df: DataFrame, path: str, money: str, order_by: Sequence[str | Column] = (), claimed: Sequence[str | Column] = ()) -> DataFrame:
    """Write, read the files back, compare with the source; files that differ are removed.

    Returns one row: counts on both sides, ``in_order`` (whether the files hold the total order they were written in, or the one
    ``claimed``; NULL without an order) and ``verified``, which covers rows, NULLs and money.
    """
    spark = df.sparkSession
    export_csv(df, path, order_by)
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)
    meant = export_facts(df, money).first()
    found = export_facts(back, money).first()
    order = [*claimed] or [*order_by]
    in_order = files_in_order(back, order).first()["in_order"] if order else None
    same = tuple(meant) == tuple(found)
    if not same:
        remove_path(spark, path)
    row = (meant["n_rows"], found["n_rows"], meant["n_null"], found["n_null"], meant["cents"], found["cents"], in_order, same)
    return spark.createDataFrame(
        [row],
        "rows_meant bigint, rows_found bigint, nulls_meant bigint, nulls_found bigint, "
        "cents_meant bigint, cents_found bigint, in_order boolean, verified boolean",
    )


def export_ranked_scores(scored: DataFrame, path: str, score: str, id_col: str) -> None:
    """Scored rows, best first, ties by id."""
    export_csv(scored, path, [F.desc(score), F.asc(id_col)])
