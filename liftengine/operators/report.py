"""The written report of each clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftengine.functions.text import fixed
from liftengine.schema import FAULTS

# fixed text of the report
TIMING_LINES = (
    ("- **First Pull:**  ", "first_pull_s"),
    ("- **Second Pull:** ", "second_pull_s"),
    ("- **Third Pull:**  ", "third_pull_s"),
    ("- **Recovery:**    ", "recovery_s"),
    ("- **Total Time:**  ", "total_s"),
)
NO_MAJOR_FAULTS = "No major faults detected based on configured checks."


def report_markdown(critiqued: DataFrame) -> DataFrame:
    """One markdown document per clip whose phases were found.

    A clip has at most seven faults, so the lines are put together within its row.
    """
    messages = F.create_map(*[F.lit(text) for pair in FAULTS.items() for text in pair])
    fault_lines = F.transform(
        "fault_codes", lambda code: F.concat(F.lit("- "), F.element_at(messages, code)))
    lift = F.col("lift_type")
    title = F.concat(
        F.lit("# Analysis Report: "), F.upper(F.substring(lift, 1, 1)),
        F.lower(F.expr("substring(lift_type, 2)")))
    lines = F.concat(
        F.array(title, F.lit(""), F.lit("## Phase Timing")),
        F.array(*[
            F.concat(F.lit(label), fixed(F.col(name), 2), F.lit("s"))
            for label, name in TIMING_LINES]),
        F.array(F.lit(""), F.lit("## Critique")),
        F.when(F.size("fault_codes") > 0, fault_lines).otherwise(
            F.array(F.lit(NO_MAJOR_FAULTS))))
    return critiqued.where("status = 'identified'").select(
        "clip_id", F.array_join(lines, "\n").alias("report"))
