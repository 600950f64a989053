"""Relearning as a stream: results arrive twice and late, the state of each question is kept by key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.practice import BOX_DAYS


def deduplicated(results: DataFrame, within: str = "60 days") -> DataFrame:
    """A stream of results without lines delivered again within the watermark."""
    timed = results.where("at IS NOT NULL AND correct IS NOT NULL AND id IS NOT NULL").withColumn("ts", F.col("at").cast("timestamp"))
    return timed.withWatermark("ts", within).dropDuplicatesWithinWatermark(["result_no"])


OUTPUT = "course string, id string, box int, due date, streak int, learned boolean, answers int"


def _fold(history: list[tuple[int, int, bool]]) -> tuple[int | None, int | None, int, bool]:
    box, due, streak, learned = None, None, 0, False
    for at, _, right in sorted(history):
        day = at // 86_400_000_000
        streak = streak + 1 if right else 0
        if not right:
            box, due, learned = 0, day + 1, False
        elif due is not None:
            box = min((box or 0) + 1, 3)
            if streak >= 3:
                due, learned = None, True
            else:
                due = day + BOX_DAYS[box]
    return box, due, streak, learned


def relearning_stream(results: DataFrame) -> DataFrame:
    """State of every question after each batch in update mode, equal to the batch fold over all results so far.

    The history of a question is kept in its state, so late answers are put in their place. It holds one question's answers of one course only.
    """

    def update(key: tuple, chunks: Iterator, state) -> Iterator:
        import datetime as dt

        import pandas as pd

        history = [tuple(x) for x in state.get[0]] if state.exists else []
        known = {n for _, n, _ in history}
        for pdf in chunks:
            for at, no, right in zip(pdf["at"], pdf["result_no"], pdf["correct"]):
                if no not in known:
                    known.add(no)
                    history.append((int(pd.Timestamp(at).value // 1000), int(no), bool(right)))
        state.update((history,))
        box, due, streak, learned = _fold(history)
        day = dt.date(1970, 1, 1) + dt.timedelta(due) if due is not None else None
        yield pd.DataFrame([[*key, box, day, streak, learned, len(history)]], columns=["course", "id", "box", "due", "streak", "learned", "answers"]).astype({"box": "object", "due": "object"})

    filled = results.where("at IS NOT NULL AND correct IS NOT NULL AND id IS NOT NULL AND course IS NOT NULL")
    return filled.groupBy("course", "id").applyInPandasWithState(update, OUTPUT, "history array<struct<at: bigint, no: bigint, right: boolean>>", "update", "NoTimeout")
