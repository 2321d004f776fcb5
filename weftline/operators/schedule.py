"""When jobs are due: intervals, cron expressions, missed runs, and the order in which queued jobs are claimed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the five cron fields: minute, hour, day, month, weekday (0 and 7 are Sunday).
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def parse_cron(expression: str) -> tuple[frozenset[int], ...]:
    """The values of the five fields; ``*``, lists, ranges and steps of ``*`` or a range."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    out = []
    for text, (low, high) in zip(parts, RANGES):
        values: set[int] = set()
        for piece in text.split(","):
            span, _, step = piece.partition("/")
            if step and int(step) < 1:
                raise ValueError(f"bad step in {text}")
            a, dash, b = (str(low), "-", str(high)) if span == "*" else span.partition("-")
            first, last = int(a), int(b) if dash else int(a)
            if not low <= first <= last <= high:
                raise ValueError(f"{text} is out of range")
            values.update(range(first, last + 1, int(step) if step and dash else 1))
        out.append(frozenset(values))
    return (*out[:4], frozenset(v % 7 for v in out[4]))


def cron_matches(expression: str, t: Column) -> Column:
    """Whether a minute fits, day of month and weekday both."""
    minute, hour, day, month, weekday = parse_cron(expression)
    ins = lambda c, s: c.isin(sorted(s))
    return ins(F.minute(t), minute) & ins(F.hour(t), hour) & ins(F.dayofmonth(t), day) & ins(F.month(t), month) & ins(F.dayofweek(t) - 1, weekday)


def next_cron(expression: str, after: Column, days: int = 366) -> Column:
    """The first fitting minute later than ``after``; null if none comes within ``days``.

    Days are narrowed first, then the few fitting minutes of a day: a row never expands to all its minutes. How
    many days must be looked at follows from the expression.
    """
    minute, hour, day, month, weekday = parse_cron(expression)
    if len(month) == 12 and len(day) == 31:
        days = min(days, 8)  # any weekday comes within a week
    elif len(month) == 12 and len(weekday) == 7 and min(day) <= 28:
        days = min(days, 32)
    start = F.date_trunc("minute", after) + F.expr("interval 1 minute")
    first_day = F.to_date(start)
    days_ = F.filter(
        F.sequence(first_day, F.date_add(first_day, days), F.expr("interval 1 day")),
        lambda d: F.dayofmonth(d).isin(sorted(day)) & F.month(d).isin(sorted(month)) & (F.dayofweek(d) - 1).isin(sorted(weekday)),
    )
    offsets = sorted(h * 60 + m for h in hour for m in minute)
    today = F.hour(start) * 60 + F.minute(start)
    later = F.array_min(F.filter(F.array(*[F.lit(o) for o in offsets]), lambda o: o >= today)) if len(offsets) <= 1440 else None
    at = lambda d, o: d.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), o)
    d0 = F.get(days_, F.lit(0))
    same_day = (d0 == first_day) & later.isNotNull()
    other = F.get(F.filter(days_, lambda d: d > first_day), F.lit(0))
    return F.when(same_day, at(first_day, later)).otherwise(at(other, F.lit(offsets[0])))


def next_interval(after: Column, start_at: Column, now: Column, seconds: Column) -> Column:
    """After a run: its time plus the interval; before the first one: the start, else now plus the interval."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.when(after.isNotNull(), after + step).when(start_at.isNotNull(), start_at).otherwise(now + step)


def missed_runs(df: DataFrame, keep: list[str], last: Column, now: Column, seconds: Column, most: int) -> DataFrame:
    """``keep…, run_no, due``: interval runs since ``last`` that are due by ``now``, ``most`` at most."""
    n = F.least(F.lit(most).cast("bigint"), F.floor((F.unix_seconds(now) - F.unix_seconds(last)) / seconds))
    rows = df.select(*keep, last.alias("_l"), seconds.alias("_s"), n.alias("_n")).where("_n >= 1")
    rows = rows.select(*keep, "_l", "_s", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("run_no"))
    return rows.select(*keep, "run_no", (F.col("_l") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("run_no") * F.col("_s"))).alias("due"))


def claim_order(jobs: DataFrame, due_by: Column, take: int, per: list[str] = ()) -> DataFrame:
    """The next ``take`` due jobs (of each ``per``): highest priority, earliest due (null first), oldest, smallest id."""
    ready = jobs.where(F.col("run_after").isNull() | (F.col("run_after") <= due_by))
    order = [F.desc("priority"), F.asc_nulls_first("run_after"), F.asc("created_at"), F.asc("job_id")]
    if per:
        return ready.withColumn("claim_no", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("claim_no") <= take)
    top = ready.orderBy(*order).limit(take)  # sorted per task, merged at the end: no task sees all jobs
    return top.withColumn("claim_no", F.row_number().over(Window.orderBy(*order)))


def queue_stats(jobs: DataFrame, statuses: list[str], now: Column) -> DataFrame:
    """``status, n, due``: one row per status, zero-filled."""
    have = jobs.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("run_after").isNull() | (F.col("run_after") <= now)).cast("bigint").alias("due"))
    dim = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return F.broadcast(dim).join(have, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("due", F.lit(0)).cast("bigint").alias("due"))


def illegal_moves(events: DataFrame, key: list[str], order: list[str], status: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Changes of status that a transition table does not allow."""
    w = Window.partitionBy(*key).orderBy(*order)
    moves = events.withColumn("from_state", F.lag(status).over(w)).withColumn("to_state", F.col(status)).where("from_state is not null and from_state <> to_state")
    ok = F.lit(False)
    for a, bs in allowed.items():
        ok = ok | ((F.col("from_state") == a) & F.col("to_state").isin(bs)) if bs else ok
    return moves.where(~ok)


def expired(lease_until: Column, now: Column) -> Column:
    """Leases that ran out; none without an end."""
    return F.coalesce(lease_until <= now, F.lit(False))


def requeue(jobs: DataFrame, now: Column) -> DataFrame:
    """Leased jobs whose lease ran out go back to the queue while attempts are left, else to the dead letters."""
    out = (F.col("status") == "leased") & expired(F.col("lease_until"), now)
    again = F.when(F.col("attempt") < F.col("max_attempts"), "queued").otherwise("dead_letter")
    return jobs.withColumns({"status": F.when(out, again).otherwise(F.col("status")), "lease_until": F.when(~out, F.col("lease_until"))})
