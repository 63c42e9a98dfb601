"""Exact rolling windows per key from events: no row looks at its window again.

A row sees the rows of its key in (t - T, t], those of its own instant only up to itself in arrival order (``closed``
windows also see the instant t - T, totals over ``instant`` windows all rows of their own instant).  Each row is two
events: it enters at t and leaves at t + T.  What a window holds is then a running sum over the events of a key, which
Spark keeps in one pass: amounts are added and taken away; a value counts where it comes into the window and where its
last row leaves; a gap leaves with its earlier row.  Work grows with the rows, not with rows times window.

A key's time is cut into chunks of at most CHUNK spans, fewer where that is more than a day but two at least; the last
span of a chunk is repeated in front of the next one, where it is only counted and not returned.  So a key that holds a
third of all rows is dealt over many tasks.  No result depends on where a chunk ends.

Rows without a time belong to no window and are left out; null keys are keys like others.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most spans of a window in a chunk of a key's time, and microseconds above which a chunk has no more spans than two.
CHUNK, LONG_US = 16, 86_400_000_000
#: Sums of doubles are exact to so many decimals, for values below 10 ** 18.
DECIMALS = 10


class Measure(NamedTuple):
    kind: str
    column: Column | None = None
    member: Column | None = None


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count() -> Measure:
    """Rows."""
    return Measure("total", F.lit(1).cast("long"))


def total(column: Column | str) -> Measure:
    """The sum; null counts as 0.  Doubles are summed as decimals of DECIMALS places, infinite ones and NaN apart."""
    return Measure("total", _column(column))


def known(column: Column | str) -> Measure:
    """Rows that have the value."""
    return Measure("total", _column(column).isNotNull().cast("long"))


def rows_with(condition: Column) -> Measure:
    """Rows for which the condition holds; null counts as not."""
    return Measure("total", F.coalesce(condition, F.lit(False)).cast("long"))


def distinct(column: Column | str) -> Measure:
    """Distinct values, null not among them."""
    return Measure("distinct", _column(column))


def largest(column: Column | str) -> Measure:
    return Measure("largest", _column(column))


def least(column: Column | str) -> Measure:
    return Measure("least", _column(column))


def latest(column: Column | str) -> Measure:
    """The value of the last row of the window that has one."""
    return Measure("latest", _column(column))


def first_time() -> Measure:
    """The time of the earliest row."""
    return Measure("first_time")


def gaps() -> Measure:
    """(n, us, squares): how many gaps between neighbouring rows are above 0, their sum and the sum of their squares."""
    return Measure("gaps")


def count_logs(column: Column | str) -> Measure:
    """The sum of c * log2(c) over the counts of all values: with n rows the entropy is log2(n) - sum / n."""
    return Measure("count_logs", _column(column))


def widest(group: Column | str, member: Column | str) -> Measure:
    """The largest number of distinct members that a group has; rows without a group have none."""
    return Measure("widest", _column(group), _column(member))


@dataclass(frozen=True)
class Rolling:
    """The windows of ``span_us`` microseconds up to each row of each key."""

    keys: tuple[str, ...]
    span_us: int
    closed: bool = False
    ts_us: str = "ts_us"
    arrival: str = "flow_id"
    instant: bool = False

    @property
    def chunk(self) -> int:
        return max(2, min(CHUNK, LONG_US // self.span_us))

    def over(self, df: DataFrame, measures: dict[str, Measure], latest_rows: int | None = None) -> DataFrame:
        """``df`` with each measure of its rows' windows; totals are those of the latest rows only, if a number is given."""
        ts, span = F.col(self.ts_us), F.lit(self.span_us)
        width = self.span_us * self.chunk
        own = F.floor(ts / width).cast("long")
        reach = ts >= (own + 1) * width - self.span_us
        rows = df.where(ts.isNotNull()).withColumn("r__chunks", F.when(reach, F.array(own, own + 1)).otherwise(F.array(own)))
        rows = rows.withColumn("r__chunk", F.explode("r__chunks")).withColumn("r__own", F.col("r__chunk") == own).drop("r__chunks")
        part = [*self.keys, "r__chunk"]
        rows = rows.repartition(*part)
        order = [self.ts_us, self.arrival]
        along = Window.partitionBy(*part).orderBy(*order)
        far = (lambda g: g > span) if self.closed else (lambda g: g >= span)
        amounts: dict[str, tuple[Column, Column]] = {}
        results: dict[str, Column] = {}
        if self.instant and (latest_rows is not None or any(m.kind != "total" for m in measures.values())):
            raise ValueError("only totals over all rows of a window see all rows of its last instant")
        run = Window.partitionBy(*part).orderBy("r__at", "r__edge", "r__seq").rowsBetween(Window.unboundedPreceding, 0)
        if self.instant:
            run = Window.partitionBy(*part).orderBy("r__at", "r__edge").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = lambda c: F.last(c, ignorenulls=True).over(run)
        running = lambda c: F.sum(c).over(run)
        carried: dict[str, tuple[Column, Column]] = {}
        needed = ["r__own"]

        def covers(name: str, value: list[Column]) -> None:
            """Columns of the row: 1 where the value comes into the window with it, 1 where it goes out with it."""
            nonlocal rows
            cols = [f"r__{name}_v{i}" for i in range(len(value))]
            rows = rows.withColumns(dict(zip(cols, value, strict=True)))
            w = Window.partitionBy(*part, *cols).orderBy(*order)
            here = F.col(cols[0]).isNotNull()
            before, after = ts - F.lag(self.ts_us).over(w), F.lead(self.ts_us).over(w) - ts
            rows = rows.withColumns({f"r__{name}_in": (here & F.coalesce(far(before), F.lit(True))).cast("long"), f"r__{name}_out": (here & F.coalesce(far(after), F.lit(True))).cast("long")})

        for name, m in measures.items():
            if m.kind == "total" and df.select(m.column).dtypes[0][1] in ("double", "float"):
                if latest_rows is not None:
                    raise ValueError("doubles aren't summed over the latest rows only")
                x, kind = m.column.cast("double"), f"decimal(28,{DECIMALS})"
                odd = F.isnan(x) | (F.abs(x) == float("inf"))
                finite = F.when(x.isNull() | odd, F.lit(0).cast(kind)).when(F.abs(x) < 1e18, x.cast(kind)).otherwise(F.raise_error(F.lit("a double is too large to be summed exactly")).cast(kind))
                for kept_as, value in {"sum": finite, "nan": F.isnan(x), "up": x == float("inf"), "down": x == float("-inf")}.items():
                    value = value if kept_as == "sum" else F.coalesce(value, F.lit(False)).cast("long")
                    amounts[f"{name}_{kept_as}"] = (value, -value)
                up, down = running(f"{name}_up") > 0, running(f"{name}_down") > 0
                results[name] = F.when((running(f"{name}_nan") > 0) | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(running(f"{name}_sum").cast("double"))
            elif m.kind == "total":
                amount = F.coalesce(m.column, F.lit(0))
                amounts[name] = (amount, -amount)
                results[name] = running(name)
                if latest_rows is not None:
                    rows = rows.withColumn(f"r__{name}_sum", F.sum(amount).over(along.rowsBetween(Window.unboundedPreceding, 0)))
                    needed.append(f"r__{name}_rows")
                    rows = rows.withColumn(f"r__{name}_rows", F.col(f"r__{name}_sum") - F.coalesce(F.lag(f"r__{name}_sum", latest_rows).over(along), F.lit(0)))
            elif m.kind == "distinct":
                covers(name, [m.column])
                amounts[name] = (F.col(f"r__{name}_in"), -F.col(f"r__{name}_out"))
                results[name] = running(name)
            elif m.kind in ("largest", "least"):
                pick, at = (F.max, F.greatest) if m.kind == "largest" else (F.min, F.least)
                block = F.floor(ts / span).cast("long")
                rows = rows.withColumns({f"r__{name}_x": m.column, "r__block": block})
                inside = Window.partitionBy(*part, "r__block")
                rows = rows.withColumns({
                    f"r__{name}_to": pick(f"r__{name}_x").over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)),
                    f"r__{name}_after": pick(f"r__{name}_x").over(inside.orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)),
                    f"r__{name}_before": pick(f"r__{name}_x").over(Window.partitionBy(*part).orderBy("r__block").rangeBetween(-1, -1)),
                })
                needed += [f"r__{name}_to", f"r__{name}_before", *(["r__block"] if "r__block" not in needed else [])]
                carried[name] = (F.lit(None), F.struct(F.col("r__block").alias("block"), F.col(f"r__{name}_after").alias("x")))
                gone, here = last(name), F.col("r__row")
                rest = F.when(gone["block"] == here["r__block"] - 1, gone["x"]).otherwise(here[f"r__{name}_before"])
                results[name] = at(here[f"r__{name}_to"], rest)
            elif m.kind == "latest":
                carried[name] = (F.when(m.column.isNotNull(), F.struct(ts.alias("at"), m.column.alias("x"))), F.lit(None))
                results[name] = F.when(~far(F.col("r__at") - last(name)["at"]), last(name)["x"])
            elif m.kind == "first_time":
                rows = rows.withColumn("r__next", F.lead(self.ts_us).over(along))
                carried[name] = (F.lit(None).cast("long"), F.col("r__next"))
                results[name] = F.coalesce(last(name), F.min(F.when(F.col("r__edge") == 1, F.col("r__at"))).over(run))
            elif m.kind == "gaps":
                rows = rows.withColumns({"r__gap": ts - F.lag(self.ts_us).over(along), "r__gap_next": F.lead(self.ts_us).over(along) - ts})
                for suffix, f in (("n", lambda g: F.coalesce((g > 0).cast("long"), F.lit(0))), ("us", lambda g: F.coalesce(g, F.lit(0))), ("squares", lambda g: F.coalesce(g.cast("decimal(18,0)") * g.cast("decimal(18,0)"), F.lit(0).cast("decimal(37,0)")))):
                    amounts[f"{name}_{suffix}"] = (f(F.col("r__gap")), -f(F.col("r__gap_next")))
                results[name] = F.struct(*(running(f"{name}_{s}").alias(s) for s in ("n", "us", "squares")))
            elif m.kind == "count_logs":
                rows = rows.withColumn(f"r__{name}_v", m.column)
                amounts[name] = (F.col(f"r__{name}_v").isNotNull().cast("long"), -F.col(f"r__{name}_v").isNotNull().cast("long"))
                carried[f"{name}_v"] = (F.col(f"r__{name}_v"), F.col(f"r__{name}_v"))
                results[name] = running(f"{name}_d")
            elif m.kind == "widest":
                covers(name, [F.when(m.column.isNotNull(), F.struct(m.column, m.member))])
                rows = rows.withColumn(f"r__{name}_g", m.column)
                amounts[name] = (F.col(f"r__{name}_in"), -F.col(f"r__{name}_out"))
                carried[f"{name}_v"] = (F.col(f"r__{name}_g"), F.col(f"r__{name}_g"))
                results[name] = running(f"{name}_d")
            else:
                raise ValueError(m.kind)

        kept = [c for c in df.columns if c not in self.keys] + needed
        enter_edge, leave_edge = 1, 2 if self.closed else 0
        none = F.when(F.lit(False), F.struct(*kept))
        enter = F.struct(F.lit(enter_edge).alias("r__edge"), ts.alias("r__at"), F.col(self.arrival).alias("r__seq"), F.struct(*kept).alias("r__row"), *(e.alias(n) for n, (e, _) in amounts.items()), *(self._typed(rows, e, x).alias(n) for n, (e, x) in carried.items()))
        leave = F.struct(F.lit(leave_edge).alias("r__edge"), (ts + span).alias("r__at"), F.col(self.arrival).alias("r__seq"), none.alias("r__row"), *(x.alias(n) for n, (_, x) in amounts.items()), *(self._typed(rows, x, e).alias(n) for n, (e, x) in carried.items()))
        events = rows.select(*part, F.explode(F.array(enter, leave)).alias("r__e")).select(*part, "r__e.*")
        for name, m in measures.items():
            by_value = Window.partitionBy(*part, f"{name}_v").orderBy("r__at", "r__edge", "r__seq").rowsBetween(Window.unboundedPreceding, 0)
            if m.kind == "count_logs":
                f = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
                events = events.withColumn(f"{name}_c", F.sum(name).over(by_value))
                events = events.withColumn(f"{name}_d", F.when(F.col(f"{name}_v").isNotNull(), f(F.col(f"{name}_c")) - f(F.col(f"{name}_c") - F.col(name))).otherwise(0.0))
            elif m.kind == "widest":
                # A group that comes to level c takes part in all levels up to c; the widest group has the top level.
                events = events.withColumn(f"{name}_c", F.sum(name).over(by_value))
                events = events.withColumn(f"{name}_l", F.when(F.col(name) > 0, F.col(f"{name}_c")).when(F.col(name) < 0, F.col(f"{name}_c") + 1))
                by_level = Window.partitionBy(*part, f"{name}_l").orderBy("r__at", "r__edge", "r__seq").rowsBetween(Window.unboundedPreceding, 0)
                events = events.withColumn(f"{name}_m", F.sum(name).over(by_level))
                events = events.withColumn(f"{name}_d", F.when((F.col(name) > 0) & (F.col(f"{name}_m") == 1), 1).when((F.col(name) < 0) & (F.col(f"{name}_m") == 0), -1).otherwise(0))
        summed = events.withColumns({f"r__out_{n}": c for n, c in results.items()})
        if latest_rows is not None:
            summed = summed.withColumn("r__n", F.sum(F.when(F.col("r__edge") == enter_edge, 1).otherwise(-1)).over(run))
            for n, m in measures.items():
                if m.kind == "total":
                    summed = summed.withColumn(f"r__out_{n}", F.when(F.col("r__n") > latest_rows, F.col(f"r__row.r__{n}_rows")).otherwise(F.col(f"r__out_{n}")))
        out = summed.where((F.col("r__edge") == enter_edge) & F.col("r__row.r__own"))
        names = [c for c in df.columns]
        return out.select(*(F.col(c) if c in self.keys else F.col("r__row")[c].alias(c) for c in names), *(F.col(f"r__out_{n}").alias(n) for n in measures))

    @staticmethod
    def _typed(rows: DataFrame, value: Column, other: Column) -> Column:
        """``value`` with the type of the other where it is a bare null."""
        return F.when(F.lit(True), value).otherwise(other)


def mean_gap_us(g: Column) -> Column:
    return F.try_divide(g["us"], g["n"])


def gap_deviation_us(g: Column, sample: bool = False, n: Column | None = None) -> Column:
    """The deviation of gaps (of a population, or of a sample); ``n`` is how many there are, if not those above 0."""
    n = (g["n"] if n is None else n).cast("double")
    us = g["us"].cast("double")
    spread = F.greatest(g["squares"].cast("double") - us * us / F.nullif(n, F.lit(0.0)), F.lit(0.0))
    return F.sqrt(F.try_divide(spread, n - 1 if sample else n))
