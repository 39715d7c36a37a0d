"""Running and trailing windows that no single key can turn into one long task.

Keyed state of a stream becomes window frames in a table. Rows of a key that has at most ``HEAVY`` of them are brought
together once: one exchange and the sorts within it serve all frames of the key (``cut=False``). A key with more rows would
sort and scan them in one task, so it is cut (``cut=True``): running values into buckets of time whose totals are added up
beforehand, frames of so many rows into chunks of consecutive rows, frames of so much time into buckets of time; the few
rows before a chunk that its frames reach back to are copied into it as context. ``by_size`` tells the two apart by a
sketch, whose list is bounded by rows / ``HEAVY``; both ways give the same values. Frames over the whole table as one
sequence are cut into slices of so many rows (``in_slices``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.session import written

HOUR_US = 3_600_000_000
CHUNK = 100_000
#: Rows of one key that one task may sort.
HEAVY = 500_000
#: Rows of a slice of the whole table.
SLICE = 1_000_000
#: Time slots a slice is put together of, at most; their counts reach the driver.
SLOTS = 200_000
_NULL = "\0"


def heavy_keys(df: DataFrame, columns: list[str], rows: int, most: int = HEAVY) -> dict[str, list[str]]:
    """For each column, the values (null as ``_NULL``) that more than most of df's rows may have: all that do, and never more than about rows / most of them.

    One pass with a sketch of fixed size; its estimates are never below the true counts. rows: how many df has, or more.
    """
    k = int(rows // most)
    if k == 0:
        return {}
    size = min(1_000_000, max(10_000, 20 * k))
    tops = df.agg(*[F.expr(f"approx_top_k(coalesce({c}, '\\0'), {k}, {size})").alias(c) for c in columns]).first()
    return {c: [t["item"] for t in tops[c] if t["count"] > most] for c in columns}


def rows_at_most(df: DataFrame) -> int:
    """Rows of the files df is read from, by their footers: a bound on the rows of a table that was only filtered or had repeated rows removed."""
    files = df.inputFiles()
    return df.sparkSession.read.parquet(*files).count() if files else df.count()


def by_size(df: DataFrame, key: str, heavy: dict[str, list[str]], step: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """step over the rows of ordinary keys in one exchange, and over those of heavy keys cut up; a table with heavy keys is written before it is split."""
    some = heavy.get(key)
    if not some:
        return step(df, False)
    whole = written(df, "split")
    named = F.coalesce(F.col(key), F.lit(_NULL))
    if len(some) <= 1000:
        light, large = whole.where(~named.isin(some)), whole.where(named.isin(some))
    else:  # a longer list is a table, still bounded
        listed = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in some], "_heavy_key string"))
        light, large = (whole.join(listed, named == F.col("_heavy_key"), how) for how in ("left_anti", "left_semi"))
    return step(light, False).unionByName(step(large, True))


def running(df: DataFrame, keys: list[str], ts: str, tie: str, sums: dict[str, Column], bucket_us: int = HOUR_US, cut: bool = True, of: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds, for each name in sums, the sum (or, by ``of``, the maximum) of its expression over the rows of the same keys before this one; at the first, a sum is 0 and a maximum null.

    Order is (ts, tie); keys may be empty: then all rows are one sequence, still bucketed. Null keys are a key like any other.
    """
    none = F.lit(0) if of is F.sum else F.lit(None)
    with_values = df.withColumns({f"_v_{n}": v for n, v in sums.items()})
    by = [F.col(k) for k in keys]
    if not cut:
        upto = W.partitionBy(*by).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, -1)
        return with_values.withColumns({n: F.coalesce(of(f"_v_{n}").over(upto), none) for n in sums}).drop(*[f"_v_{n}" for n in sums])
    b = with_values.withColumn("_bucket", F.expr(f"{ts} div {bucket_us}"))
    totals = b.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(by)], F.col("_bucket").alias("_b")).agg(*[of(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    upto = W.partitionBy(*[f"_k{i}" for i in range(len(by))] or [F.lit(0)]).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[f"_k{i}" for i in range(len(by))], "_b", *[of(f"_t_{n}").over(upto).alias(f"_o_{n}") for n in sums])
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(by):
        on = on & k.eqNullSafe(F.col(f"_k{i}"))
    inner = W.partitionBy(*by, "_bucket").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, -1)
    both = (lambda o, v: F.coalesce(o, none) + F.coalesce(v, none)) if of is F.sum else F.greatest
    joined = b.join(offsets, on).withColumns({n: both(F.col(f"_o_{n}"), of(f"_v_{n}").over(inner)) for n in sums})
    return joined.drop("_bucket", "_b", *[f"_k{i}" for i in range(len(by))], *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def by_rows(df: DataFrame, keys: list[str], ts: str, tie: str, back: int, columns: dict | list[dict], chunk: int = CHUNK, cut: bool = True) -> DataFrame:
    """Adds columns computed over frames of at most ``back`` rows before the row, within keys in the order (ts, tie).

    columns: name -> function from the window to an expression, or several such in a row. Cut, rows are numbered within
    their key by ``running``; each chunk of consecutive numbers also holds the last ``back`` rows of the one before.
    """
    steps = columns if isinstance(columns, list) else [columns]
    if not cut:
        w = W.partitionBy(*keys).orderBy(ts, tie)
        for step in steps:
            df = df.withColumns({n: f(w) for n, f in step.items()})
        return df
    numbered = running(df, keys, ts, tie, {"_at": F.lit(1)})
    own = F.expr(f"_at div {chunk}")
    late = F.expr(f"_at % {chunk} >= {chunk - back}")
    spread = numbered.withColumn("_c", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_context", F.col("_c") != own)
    w = W.partitionBy(*keys, "_c").orderBy("_at")
    for step in steps:
        spread = spread.withColumns({n: f(w) for n, f in step.items()})
    return spread.where(~F.col("_context")).drop("_at", "_c", "_context")


def by_time(df: DataFrame, keys: list[str], ts: str, back_us: int, columns: dict, bucket_us: int = HOUR_US, cut: bool = True) -> DataFrame:
    """Adds columns computed over frames that reach at most back_us before the row (rows of the same instant included), within keys."""
    if not cut:
        w = W.partitionBy(*keys).orderBy(ts)
        return df.withColumns({n: f(w) for n, f in columns.items()})
    own = F.expr(f"{ts} div {bucket_us}")
    reach = F.expr(f"({ts} + {back_us}) div {bucket_us}")
    spread = df.withColumn("_c", F.explode(F.sequence(own, reach))).withColumn("_context", F.col("_c") != own)
    w = W.partitionBy(*keys, "_c").orderBy(ts)
    return spread.withColumns({n: f(w) for n, f in columns.items()}).where(~F.col("_context")).drop("_c", "_context")


def trailing_count(df: DataFrame, keys: list[str], ts: str, tie: str, name: str, window_us: int, cut: bool = True) -> DataFrame:
    """Adds the number of rows of the same keys from window_us before the row to its own instant, both included.

    Cut, a row is counted in when it comes and out once the window has passed: the count is a running sum over both kinds
    of events, and no task holds a whole window, however many rows of one key there are in it.
    """
    if not cut:
        return by_time(df, keys, ts, window_us, {name: lambda w: F.count(F.lit(1)).over(w.rangeBetween(-window_us, 0))}, cut=False)
    kind = F.explode(F.array(F.struct(F.lit(0).alias("late"), F.lit(1).alias("d")), F.struct(F.lit(1).alias("late"), F.lit(-1).alias("d")), F.struct(F.lit(2).alias("late"), F.lit(0).alias("d"))))
    events = df.withColumn("_e", kind).withColumn("_t", F.col(ts) + F.when(F.col("_e.late") == 1, F.lit(window_us + 1)).otherwise(F.lit(0)))
    # at one instant all arrivals and departures come before the rows that ask
    order = F.concat(F.when(F.col("_e.late") == 2, F.lit("1-")).otherwise(F.lit("0-")), F.col(tie).cast("string"))
    summed = running(events.withColumn("_o", order), keys, "_t", "_o", {name: F.col("_e.d")}, bucket_us=60_000_000)
    return summed.where("_e.late = 2").drop("_e", "_t", "_o")


def in_slices(df: DataFrame, ts: str, tie: str, sums: dict[str, Column], back: int, steps: list[dict], rows: int = SLICE) -> DataFrame:
    """All rows as one sequence in the order (ts, tie): adds running sums over the rows before, then columns over frames of at most back rows.

    The time between first and last row is divided into at most ``SLOTS`` slots, whose counts and sums reach the driver;
    neighbouring slots make up slices of about ``rows`` rows (fewer while there are more cores than slices), and the last
    slots of a slice, with at least ``back`` rows, go into the next one too as context. df is read twice: give a written one.
    """
    spark = df.sparkSession
    lo, hi, n = df.agg(F.min(ts), F.max(ts), F.count(F.lit(1))).first()
    target = max(back + 1, min(rows, -(-n // spark.sparkContext.defaultParallelism)))
    width = max(1, ((hi or 0) - (lo or 0)) // max(1, min(SLOTS, 20 * n // target)) + 1)
    slot = F.expr(f"({ts} - {lo or 0}) div {width}")
    with_values = df.withColumn("_slot", slot).withColumns({f"_v_{k}": v for k, v in sums.items()})
    found = sorted(with_values.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_v_{k}").alias(f"s_{k}") for k in sums]).collect())
    slices, open_rows = [[]], 0
    for row in found:
        if open_rows >= target:
            slices.append([])
            open_rows = 0
        slices[-1].append(row)
        open_rows += row.n
    if len(slices) > 1 and open_rows < target:
        last = slices.pop()
        slices[-1] += last
    places, offsets, before = [], [], [0] * len(sums)
    for c, part in enumerate(slices):
        offsets.append((c, *map(str, before)))
        after = 0
        for row in reversed(part):
            places.append((row["_slot"], c, after < back and c + 1 < len(slices)))
            after += row.n
        before = [b + sum(row[f"s_{k}"] or 0 for row in part) for b, k in zip(before, sums)]
    at = F.broadcast(spark.createDataFrame(places, "_slot bigint, _own int, _tail boolean"))
    base = F.broadcast(spark.createDataFrame(offsets, ", ".join(["_c int", *[f"_o_{k} string" for k in sums]])))
    spread = with_values.join(at, "_slot").withColumn("_c", F.explode(F.when(F.col("_tail"), F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))).withColumn("_context", F.col("_c") != F.col("_own"))
    w = W.partitionBy("_c").orderBy(ts, tie)
    first = {f"_r_{k}": F.sum(F.when(~F.col("_context"), F.col(f"_v_{k}"))).over(w.rowsBetween(W.unboundedPreceding, -1)) for k in sums}
    for step in [first | steps[0], *steps[1:]]:
        spread = spread.withColumns({k: (f if isinstance(f, Column) else f(w)) for k, f in step.items()})
    types = {k: with_values.schema[f"_v_{k}"].dataType.typeName() for k in sums}
    whole = lambda k: "decimal(38,0)" if types[k] == "decimal" else "bigint"
    out = spread.where(~F.col("_context")).join(base, "_c").withColumns({k: F.col(f"_o_{k}").cast(whole(k)) + F.coalesce(F.col(f"_r_{k}"), F.lit(0)) for k in sums})
    return out.drop("_slot", "_own", "_tail", "_c", "_context", *[f"_{a}_{k}" for k in sums for a in "vro"])
