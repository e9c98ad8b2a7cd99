"""How far one window reaches: whole clips, or clips cut into blocks.

Nearly every rule here looks along a clip in frame order.  For ordinary clips a
Spark window per clip is the right plan: one exchange and one sort serve every
step.  One clip may, however, hold a large share of all rows, and a window would
then put that clip into a single task.  So rules state *what* they need from the
clip (`RunningSum`, `Previous`, `LastKnown`, ...) and a span decides how:

``Whole``   one window per clip; used when the longest clip is within a bound.
``Blocks``  clips are cut into blocks of consecutive frames.  Each step sums up
            every block in one small row, runs a window over those summary rows
            to find what enters the block from outside, and joins that back on
            (clip, block).  No task ever holds more than a block of rows, or one
            summary row per block.  The block length grows with the square root
            of the longest clip, so both levels stay small.

Both give the same rows.  ``Blocks`` reads its input twice per step.  It therefore writes
it to the shared scratch folder first; where only totals are asked for, it writes the
summary rows instead and the input is merely scanned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftengine.sources.scratch import write_scratch

# rows of one clip that a single task may sort and scan
ROWS_PER_TASK = 32_768
BLOCK = "_blk"
# where blocks are folded row by row: rows of a block, and blocks of a group
FOLD_ROWS = 4096
FOLD_FAN = 256


def _up(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _last_known(expr, window):
    return F.last(expr, ignorenulls=True).over(window)


@dataclass(frozen=True)
class RunningSum:
    """Sum of the rows so far; a missing value stays missing and adds nothing."""

    expr: Column

    def whole(self, asc, desc):
        return F.when(self.expr.isNotNull(), F.sum(self.expr).over(_up(asc)))

    def summary(self, order):
        return {"sum": F.sum(self.expr)}

    def carry(self, part, blocks):
        return {"sum": F.sum(part["sum"]).over(_before(blocks))}

    def local(self, carry, asc, desc):
        own = F.sum(self.expr).over(_up(asc))
        return F.when(self.expr.isNotNull(), F.coalesce(carry["sum"] + own, own))


@dataclass(frozen=True)
class Previous:
    """Value on the preceding row, NULL on the first."""

    expr: Column

    def whole(self, asc, desc):
        return F.lag(self.expr).over(asc)

    def summary(self, order):
        return {"last": F.max_by(F.struct(self.expr.alias("v")), order)}

    def carry(self, part, blocks):
        return {"last": F.lag(part["last"]).over(blocks.forward)}

    def local(self, carry, asc, desc):
        own = F.lag(F.struct(self.expr.alias("v"))).over(asc)
        return F.coalesce(own, carry["last"])["v"]


@dataclass(frozen=True)
class LastKnown:
    """Latest value that is present, at or before the row (or strictly before it)."""

    expr: Column
    inclusive: bool = True

    def _frame(self, window):
        return _up(window) if self.inclusive else _before(window)

    def whole(self, asc, desc):
        return _last_known(self.expr, self._frame(asc))

    def summary(self, order):
        return {"last": F.max_by(self.expr, F.when(self.expr.isNotNull(), order))}

    def carry(self, part, blocks):
        return {"last": _last_known(part["last"], _before(blocks))}

    def local(self, carry, asc, desc):
        return F.coalesce(_last_known(self.expr, self._frame(asc)), carry["last"])


@dataclass(frozen=True)
class NextKnown:
    """First value that is present, at or after the row.

    Written as the last known value in reverse order: Spark keeps a running state
    for that, where a frame reaching to the end would be rescanned for each row.
    """

    expr: Column

    def whole(self, asc, desc):
        return _last_known(self.expr, _up(desc))

    def summary(self, order):
        return {"first": F.min_by(self.expr, F.when(self.expr.isNotNull(), order))}

    def carry(self, part, blocks):
        return {"first": _last_known(part["first"], _before(blocks.reverse))}

    def local(self, carry, asc, desc):
        return F.coalesce(_last_known(self.expr, _up(desc)), carry["first"])


@dataclass(frozen=True)
class Nearby:
    """Array of the (present) values from ``reach`` rows before to ``reach`` after."""

    expr: Column
    reach: int

    def whole(self, asc, desc):
        return F.collect_list(self.expr).over(asc.rowsBetween(-self.reach, self.reach))

    def summary(self, order):
        rows = F.transform(
            F.sort_array(F.collect_list(F.struct(order.alias("o"), self.expr.alias("v")))),
            lambda row: row["v"],
        )
        size = F.count(F.lit(1)).cast("int")
        return {
            "head": F.slice(rows, 1, self.reach),
            "tail": F.slice(rows, F.greatest(size - self.reach, F.lit(0)) + 1, F.lit(self.reach)),
            "size": size,
        }

    def carry(self, part, blocks):
        def around(name, first, last):
            return F.flatten(F.collect_list(part[name]).over(blocks.rowsBetween(first, last)))

        return {
            "left": around("tail", -self.reach, -1),
            "right": around("head", 1, self.reach),
            "size": part["size"],
        }

    def local(self, carry, asc, desc):
        reach = F.lit(self.reach)
        row = F.row_number().over(asc)
        left_gap = F.greatest(reach - (row - 1), F.lit(0))
        right_gap = F.greatest(reach - (carry["size"] - row), F.lit(0))
        skip = F.greatest(F.size(carry["left"]) - left_gap, F.lit(0))
        own = F.collect_list(self.expr).over(asc.rowsBetween(-self.reach, self.reach))
        return F.concat(
            F.slice(carry["left"], skip + 1, left_gap),
            own,
            F.slice(carry["right"], F.lit(1), right_gap),
        )


@dataclass(frozen=True)
class Total:
    """``min``, ``max`` or ``sum`` over the whole clip, on every row."""

    kind: str
    expr: Column

    @property
    def fold(self):
        return {"min": F.min, "max": F.max, "sum": F.sum}[self.kind]

    def whole(self, asc, desc):
        everything = asc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self.fold(self.expr).over(everything)

    def summary(self, order):
        return {"part": self.fold(self.expr)}

    def carry(self, part, blocks):
        everything = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return {"all": self.fold(part["part"]).over(everything)}

    def local(self, carry, asc, desc):
        return carry["all"]


@dataclass(frozen=True)
class Whole:
    """One window per clip."""

    key: str = "clip_id"
    order: tuple[str, ...] = ("frame",)

    def derive(self, df: DataFrame, **needs) -> DataFrame:
        """Add one column per need."""
        asc = Window.partitionBy(self.key).orderBy(*self.order)
        desc = Window.partitionBy(self.key).orderBy(*[F.desc(c) for c in self.order])
        return df.withColumns({name: need.whole(asc, desc) for name, need in needs.items()})

    def settle(self, df: DataFrame) -> DataFrame:
        """``df`` in a form that is cheap to read several times."""
        return df

    def attach(self, df: DataFrame, per_clip: DataFrame) -> DataFrame:
        """Left join a table with one row per clip; Spark broadcasts it if its size allows."""
        return df.join(per_clip, self.key, "left")

    def spread(self, df: DataFrame, count: Column, name: str) -> DataFrame:
        """One row per number 0 .. count-1 for each row of ``df``; lists stay short."""
        return _spread(df, count, name, ROWS_PER_TASK)


class _BlockWindow:
    """Window over a clip's block summaries, with its reverse at hand."""

    def __init__(self, key, block):
        self.forward = Window.partitionBy(key).orderBy(block)
        self.reverse = Window.partitionBy(key).orderBy(F.desc(block))

    def rowsBetween(self, first, last):  # noqa: N802 - Spark's own name
        return self.forward.rowsBetween(first, last)


@dataclass(frozen=True)
class Blocks:
    """Clips cut into blocks of consecutive frames."""

    size: int
    key: str = "clip_id"
    order: tuple[str, ...] = ("frame",)
    block: Column | None = field(default=None, compare=False)

    @property
    def fold_size(self) -> int:
        """Rows of a block that is folded row by row, in one list."""
        return min(self.size, FOLD_ROWS)

    @property
    def fold_fan(self) -> int:
        """Blocks, or groups of them, that one row of the level above holds."""
        return max(4, min(self.size // 8, FOLD_FAN))

    def _with_block(self, df):
        if BLOCK in df.columns:
            return df
        block = self.block
        if block is None:
            block = F.floor(F.col(self.order[0]) / F.lit(self.size))
        return df.withColumn(BLOCK, block.cast("bigint"))

    def derive(self, df: DataFrame, **needs) -> DataFrame:
        """Add one column per need."""
        totals_only = all(isinstance(need, Total) for need in needs.values())
        rows = self._with_block(df) if totals_only else self.settle(df)
        order = F.struct(*self.order) if len(self.order) > 1 else F.col(self.order[0])

        summaries, parts = [], {}
        for name, need in needs.items():
            parts[name] = {}
            for part, expr in need.summary(order).items():
                parts[name][part] = F.col(f"_s_{name}_{part}")
                summaries.append(expr.alias(f"_s_{name}_{part}"))
        per_block = rows.groupBy(self.key, BLOCK).agg(*summaries)

        blocks = _BlockWindow(self.key, BLOCK)
        carried, carries = [], {}
        for name, need in needs.items():
            carries[name] = {}
            for part, expr in need.carry(parts[name], blocks).items():
                carries[name][part] = F.col(f"_c_{name}_{part}")
                carried.append(expr.alias(f"_c_{name}_{part}"))
        carry = per_block.select(self.key, BLOCK, *carried)
        if totals_only:
            carry = write_scratch(carry, "totals")

        asc = Window.partitionBy(self.key, BLOCK).orderBy(*self.order)
        desc = Window.partitionBy(self.key, BLOCK).orderBy(*[F.desc(c) for c in self.order])
        joined = rows.join(carry, [self.key, BLOCK], "left")
        local = {name: need.local(carries[name], asc, desc) for name, need in needs.items()}
        return joined.withColumns(local).select(
            *[c for c in rows.columns if c not in local], *local)

    def settle(self, df: DataFrame) -> DataFrame:
        """``df`` with its blocks, written to the scratch folder and read back."""
        return write_scratch(self._with_block(df))

    def attach(self, df: DataFrame, per_clip: DataFrame) -> DataFrame:
        """Left join a table with one row per clip, by way of the list of blocks.

        Joining on (clip, block) keeps a long clip's rows spread over many tasks.
        """
        df = self._with_block(df)
        per_block = df.select(self.key, BLOCK).distinct().join(per_clip, self.key, "left")
        return df.join(per_block, [self.key, BLOCK], "left")

    def spread(self, df: DataFrame, count: Column, name: str) -> DataFrame:
        """One row per number 0 .. count-1 for each row of ``df``, a block at a time."""
        return _spread(df, count, name, self.size, self.key)


def _spread(df: DataFrame, count: Column, name: str, step: int, key: str | None = None):
    """Numbers 0 .. count-1 in two steps, dealt out between them if there is a key."""
    starts = df.where(count > 0).withColumn("_n", count.cast("bigint")).withColumn(
        "_start", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(step).cast("bigint"))))
    dealt = starts.repartition(key, "_start") if key else starts
    return dealt.withColumn(name, F.explode(F.sequence(
        F.col("_start"), F.least(F.col("_start") + step, F.col("_n")) - 1))).drop("_n", "_start")


def join_frames(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join two tables with a row (or a few) per clip and frame.

    Both sides grow with the footage, so neither may be broadcast; Spark's estimate of a
    side that was unpacked or aggregated can be far too small, hence the explicit merge.
    """
    return left.join(right.hint("merge"), ["clip_id", "frame"], how)


def span_for(longest: int | None, rows_per_task: int = ROWS_PER_TASK):
    """The span for clips of which the longest has ``longest`` rows."""
    if (longest or 0) <= rows_per_task:
        return Whole()
    return Blocks(max(rows_per_task, math.isqrt(longest)))


def longest_group(df: DataFrame, *keys: str) -> int:
    """Rows of the largest group; one pre-aggregated pass over the key columns alone."""
    counts = df.groupBy(*keys).count()
    return counts.agg(F.max("count").alias("n")).first()["n"] or 0


def measure(df: DataFrame, key: str = "clip_id", rows_per_task: int = ROWS_PER_TASK):
    """Look at the longest clip of ``df`` and choose the span."""
    return span_for(longest_group(df, key), rows_per_task)
