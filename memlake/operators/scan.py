"""Running values over long keys.

A window partitioned by conversation alone puts a whole conversation on one task. These
helpers cut each key into chunks of its ordering column, run the window inside a chunk,
and carry only one summary row per chunk across: a conversation holding a third of all
rows is spread over as many tasks as it has chunks.

Null keys are a key of their own. Rows whose chunk is null (no time) come after all others of
their key, in a chunk of their own. No row is lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "__chunk"
LAST_CHUNK = (1 << 62)


def time_chunk(at: Column, hours: int = 24) -> Column:
    """Chunk number of a timestamp; non-decreasing in it."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("HOUR", epoch, at) / hours)


def number_chunk(n: Column, width: int = 100_000) -> Column:
    return F.floor(n / width)


def _chunked(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(CHUNK, F.coalesce(chunk.cast("bigint"), F.lit(LAST_CHUNK)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null; the keys come once."""
    r = right.withColumnsRenamed({c: f"__j_{c}" for c in keys})
    return left.join(r, [F.col(c).eqNullSafe(F.col(f"__j_{c}")) for c in keys]).drop(*[f"__j_{c}" for c in keys])


@dataclass
class Running:
    """What to compute per row, in key order.

    sums: running total including the row. lasts: newest non-null value before the row.
    mins: least non-null value before the row. lags / leads: value of the row just before / after. Each maps an output column to an
    expression.
    """

    sums: dict[str, Column] = field(default_factory=dict)
    lasts: dict[str, Column] = field(default_factory=dict)
    lags: dict[str, Column] = field(default_factory=dict)
    leads: dict[str, Column] = field(default_factory=dict)
    mins: dict[str, Column] = field(default_factory=dict)


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column, want: Running) -> DataFrame:
    """Add the running columns; ``order`` must be total within a key."""
    rows = _chunked(df, chunk)
    by = F.struct(*order)
    aggs = [F.sum(c).alias(f"__s_{n}") for n, c in want.sums.items()]
    aggs += [F.max_by(c, F.when(c.isNotNull(), by)).alias(f"__l_{n}") for n, c in want.lasts.items()]
    aggs += [F.min(c).alias(f"__m_{n}") for n, c in want.mins.items()]
    if want.lags:
        tail = F.struct(*[c.alias(n) for n, c in want.lags.items()])
        aggs.append(F.max_by(tail, by).alias("__tail"))
    if want.leads:
        head = F.struct(*[c.alias(n) for n, c in want.leads.items()])
        aggs.append(F.min_by(head, by).alias("__head"))
    summary = rows.groupBy(*keys, CHUNK).agg(*aggs)

    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"__s_{n}").over(before).alias(f"__s_{n}") for n in want.sums]
    carried += [F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__l_{n}") for n in want.lasts]
    carried += [F.min(f"__m_{n}").over(before).alias(f"__m_{n}") for n in want.mins]
    if want.lags:
        carried.append(F.lag("__tail").over(over_chunks).alias("__tail"))
    if want.leads:
        carried.append(F.lead("__head").over(over_chunks).alias("__head"))
    joined = join_null_safe(rows, summary.select(*keys, CHUNK, *carried), [*keys, CHUNK])

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    added = {n: F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in want.sums.items()}
    added |= {n: F.coalesce(F.last(c, ignorenulls=True).over(earlier), F.col(f"__l_{n}")) for n, c in want.lasts.items()}
    added |= {n: F.least(F.min(c).over(earlier), F.col(f"__m_{n}")) for n, c in want.mins.items()}
    first = F.row_number().over(inside) == 1
    added |= {n: F.when(first, F.col(f"__tail.{n}")).otherwise(F.lag(c).over(inside)) for n, c in want.lags.items()}
    final = F.lead(F.lit(1)).over(inside).isNull()
    added |= {n: F.when(final, F.col(f"__head.{n}")).otherwise(F.lead(c).over(inside)) for n, c in want.leads.items()}
    return joined.withColumns(added).select(*df.columns, *added)


def within(df: DataFrame, keys: list[str], order: list[str], want: Running) -> DataFrame:
    """The same columns for keys whose rows fit a task, such as the lines of one cell: one
    shuffle serves all that is asked by the same first key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    added = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in want.sums.items()}
    added |= {n: F.last(c, ignorenulls=True).over(earlier) for n, c in want.lasts.items()}
    added |= {n: F.min(c).over(earlier) for n, c in want.mins.items()}
    added |= {n: F.lag(c).over(w) for n, c in want.lags.items()} | {n: F.lead(c).over(w) for n, c in want.leads.items()}
    return df.withColumns(added)


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rn") -> DataFrame:
    """1-based position within the key."""
    return running(df, keys, order, chunk, Running(sums={name: F.lit(1).cast("bigint")}))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark keeps only k rows per key and task before the shuffle
    (window group limit), so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__first").drop("__first")


def segment(df: DataFrame, keys: list[str], order: list[str], chunk: Column, cols: list[str], begins, why) -> DataFrame:
    """Split each key into sessions in one pass over the rows.

    ``begins(prev, cur)`` says whether a row starts a session, given structs of ``cols`` for
    the row before and the row itself; ``why(prev, cur)`` labels the start. Adds ``pos``
    (1-based in the key), ``session`` (0-based), ``start_pos`` and ``begin_why``. Rows are
    shuffled once, by (key, chunk); only chunk summaries cross chunks.
    """
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = _chunked(df, chunk).withColumn("__cur", F.struct(*cols))
    rows = rows.withColumns({"__prev": F.lag("__cur").over(inside), "__lpos": F.row_number().over(inside)})
    inner = F.col("__lpos") > 1
    rows = rows.withColumn("__flag", inner & F.coalesce(begins(F.col("__prev"), F.col("__cur")), F.lit(False)))
    at = F.when(F.col("__flag"), F.col("__lpos"))
    rows = rows.withColumns({"__lsess": F.sum(F.col("__flag").cast("bigint")).over(upto), "__lstart": F.max(at).over(upto)})

    by = F.struct(*order)
    chunks = rows.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col("__flag").cast("bigint")).alias("__s"), F.max(at).alias("__ls"),
        F.min_by("__cur", by).alias("__head"), F.max_by("__cur", by).alias("__tail"))
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("__pt", F.lag("__tail").over(over_chunks))
    first_begins = F.col("__pt").isNotNull() & F.coalesce(begins(F.col("__pt"), F.col("__head")), F.lit(False))
    chunks = chunks.withColumns({
        "__ff": first_begins, "__fwhy": F.when(first_begins, why(F.col("__pt"), F.col("__head"))),
        "__n0": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    chunks = chunks.withColumn(
        "__abs", F.col("__n0") + F.coalesce("__ls", F.when(F.col("__ff") | F.col("__pt").isNull(), F.lit(1))))
    chunks = chunks.select(
        *keys, CHUNK, "__ff", "__fwhy", "__n0", F.col("__pt").isNull().alias("__top"),
        F.coalesce(F.sum(F.col("__s") + F.col("__ff").cast("bigint")).over(before), F.lit(0)).alias("__s0"),
        F.last("__abs", ignorenulls=True).over(before).alias("__start0"))

    out = join_null_safe(rows, chunks, [*keys, CHUNK])
    local_start = F.coalesce("__lstart", F.when(F.col("__ff") | F.col("__top"), F.lit(1)))
    added = {
        "pos": F.col("__n0") + F.col("__lpos"),
        "session": F.col("__s0") + F.col("__ff").cast("bigint") + F.col("__lsess"),
        "start_pos": F.coalesce(F.col("__n0") + local_start, F.col("__start0")),
        "begin_why": F.when(inner, F.when(F.col("__flag"), why(F.col("__prev"), F.col("__cur")))).otherwise(F.col("__fwhy")),
    }
    return out.withColumns(added).select(*df.columns, *added)
