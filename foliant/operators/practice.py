"""Samples and orders for practice, and the state of relearning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.shapes import hash_uniform, split_row_number

#: Days until the next review by box, and days of reviews after learning.
BOX_DAYS = [1, 3, 7, 14]
REVIEW_GAPS = [1, 3, 7, 14, 30]


def weighted_sample(pool: DataFrame, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight: the n smallest of -ln(u) / weight with hashed u. Ties by key; rows without positive weight never come.

    The plan keeps n rows for each partition (take-ordered), it never sorts the whole pool.
    """
    u = hash_uniform(F.col(key), seed=seed)
    keyed = pool.withColumn("draw", F.round(-F.log(u) / weight, 9)).where(weight > 0)
    return keyed.orderBy("draw", key).limit(n)


def preferred_first(pool: DataFrame, key: str, preferred: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows in hashed order, the preferred ones before the others."""
    return pool.withColumn("preferred", preferred).withColumn("u", F.round(hash_uniform(F.col(key), seed=seed), 12)).orderBy(F.col("preferred").desc(), "u", key).limit(n)


#: Parts of the unit interval into which hashed orders of one group are divided.
ORDER_PARTS = 256


def interleaved(rows: DataFrame, group: str, key: str, keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """place of every row in an order in which groups are spread evenly: by (rank in its group - 0.5) / size of the group.

    Both orders run over the unit interval, by hash and by spot, and are numbered in ORDER_PARTS parts, so that a hot group is no single task.
    """
    keys = keys or []
    part = lambda u: F.floor(u * ORDER_PARTS)
    hashed = rows.withColumn("__u", hash_uniform(F.col(key), seed=seed))
    ranked = split_row_number(hashed, [*keys, group], part(F.col("__u")), [F.col("__u"), F.col(key)], "__rank")
    sizes = rows.groupBy(*[F.col(k).alias(f"__of{i}") for i, k in enumerate([*keys, group])]).agg(F.count("*").alias("__size"))
    same = [F.col(k).eqNullSafe(F.col(f"__of{i}")) for i, k in enumerate([*keys, group])]
    spots = ranked.join(sizes, same).select(*rows.columns, F.round((F.col("__rank") - 0.5) / F.col("__size"), 9).alias("__spot"))
    placed = split_row_number(spots, keys, part(F.col("__spot")), [F.col("__spot"), F.col(group), F.col(key)], "place")
    return placed.drop("__spot")


def distinct_results(results: DataFrame) -> DataFrame:
    """Results without lines delivered twice and without time or outcome missing: result_no, course, id, correct, at."""
    filled = results.where("at IS NOT NULL AND correct IS NOT NULL AND id IS NOT NULL")
    return filled.select("result_no", "course", "id", "correct", "at").dropDuplicates(["result_no"])


def relearning(results: DataFrame, keys: list[str]) -> DataFrame:
    """State of every question from its history: box, due and whether it is learned.

    A miss puts it in box 0, due the next day. A right answer counts only while something is due: it goes up a box (three at most) and
    is due after 1, 3, 7 or 14 days; after three right answers in a row it is learned and nothing is due. Answers count in order of time, then number.
    """
    history = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "result_no", "correct"))).alias("history"))
    gaps = F.array(*[F.lit(d) for d in BOX_DAYS])
    state = F.struct(F.lit(None).cast("int").alias("box"), F.lit(None).cast("date").alias("due"), F.lit(0).alias("streak"), F.lit(False).alias("learned"))

    def step(a, h):
        day = F.to_date(h["at"])
        box = F.least(F.coalesce(a["box"], F.lit(0)) + 1, F.lit(3))
        streak = F.when(h["correct"], a["streak"] + 1).otherwise(0)
        counts = h["correct"] & a["due"].isNotNull()
        done = counts & (streak >= 3)
        return F.struct(
            F.when(~h["correct"], 0).when(counts, box).otherwise(a["box"]).cast("int").alias("box"),
            F.when(~h["correct"], F.date_add(day, 1)).when(done, F.lit(None).cast("date")).when(counts, F.date_add(day, F.element_at(gaps, box + 1))).otherwise(a["due"]).alias("due"),
            streak.cast("int").alias("streak"),
            F.when(~h["correct"], F.lit(False)).when(done, F.lit(True)).otherwise(a["learned"]).alias("learned"),
        )

    folded = history.withColumn("s", F.aggregate("history", state, step))
    return folded.select(*keys, F.col("s.box").alias("box"), F.col("s.due").alias("due"), F.col("s.streak").alias("streak"), F.col("s.learned").alias("learned"), F.size("history").alias("answers"))


def due_questions(states: DataFrame, as_of: Column) -> DataFrame:
    """Questions that are due on a day and not learned."""
    return states.where(F.col("due").isNotNull() & (F.col("due") <= as_of) & ~F.col("learned"))


def streaks(results: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal outcomes in order of time: keys, run number, outcome, answers, first and last time."""
    w = Window.partitionBy(*keys).orderBy("at", "result_no")
    changed = F.coalesce((F.col("correct") != F.lag("correct").over(w)).cast("int"), F.lit(1))
    runs = results.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("correct").alias("correct"), F.count("*").alias("answers"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def reviews(learned: DataFrame, keys: list[str], day: str, rest_weekdays: tuple[int, ...] = (1,)) -> DataFrame:
    """Review days after a day of learning: 1, 3, 7, 14 and 30 days later, put off while they fall on a rest day (1 is Sunday)."""
    each = learned.select(*keys, day, F.explode(F.array(*[F.lit(g) for g in REVIEW_GAPS])).alias("gap"))
    date = F.date_add(F.col(day), F.col("gap"))
    for _ in range(7 if len(rest_weekdays) > 1 else 1):
        date = F.when(F.dayofweek(date).isin(*rest_weekdays), F.date_add(date, 1)).otherwise(date)
    return each.select(*keys, "gap", date.alias("review_on"))


def fill_days(work: DataFrame, keys: list[str], minutes: str, order: list[Column], capacity: int = 120) -> DataFrame:
    """Work cut into days of equal capacity in order: keys, day (from 1) and minutes on it. A piece of work meets exactly the days its span of summed minutes crosses."""
    w = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spans = work.where(F.col(minutes) > 0).withColumn("hi", F.sum(minutes).over(w)).withColumn("lo", F.col("hi") - F.col(minutes))
    first, last = F.floor(F.col("lo") / capacity), F.ceil(F.col("hi") / capacity) - 1
    days = spans.withColumn("day0", F.explode(F.sequence(first, last)))
    used = F.least("hi", (F.col("day0") + 1) * capacity) - F.greatest("lo", F.col("day0") * capacity)
    return days.select(*keys, (F.col("day0") + 1).cast("int").alias("day"), used.cast("long").alias("minutes"))


def sessions(results: DataFrame, keys: list[str], gap: str = "30 minutes") -> DataFrame:
    """Study sessions: answers no further apart than the gap.

    The answers of one day are brought into sessions first, by key and day; sessions that go on over midnight are then joined among those rows, of which a day has a bounded
    number however many answers there are.
    """
    timed = results.withColumn("ts", F.col("at").cast("timestamp"))
    daily = timed.groupBy(*keys, F.to_date("ts").alias("__day"), F.session_window("ts", gap).alias("w"))
    daily = daily.agg(F.count("*").alias("answers"), F.sum(F.col("correct").cast("int")).alias("right"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    w = Window.partitionBy(*keys).orderBy("first_at")
    apart = F.col("first_at").cast("timestamp") > F.lag("last_at").over(w).cast("timestamp") + F.expr(f"INTERVAL {gap}")
    runs = daily.withColumn("__run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(*keys, "__run").agg(F.sum("answers").alias("answers"), F.sum("right").alias("right"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return joined.drop("__run")
