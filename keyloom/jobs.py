"""Transform jobs: ordered SQL and Python stages from YAML, with schedules and states."""

from __future__ import annotations

import calendar
import itertools
import re
import threading
import time
from dataclasses import dataclass, field
from datetime import datetime, timedelta

# The states a job may have.
STATES = ["UNKNOWN", "FINISHED", "CREATED", "IDLE", "RUNNING", "PARTIALLY_FAILING", "PARTIALLY_FAILED", "FAILING", "FAILED", "CLOSING", "CLOSED"]


@dataclass
class Job:
    tasks: list[dict]
    export: str = "none"
    file: str | None = None
    schedule: str | None = None
    stop_on_failure: bool = True
    state: str = "CREATED"
    error: str | None = None
    runs: int = 0
    result: object = field(default=None, repr=False)


def read_job(file: str) -> Job:
    import yaml

    with open(file) as f:
        body = yaml.safe_load(f)
    return Job([{k: v for k, v in t.items()} for t in body.get("taskList", [])], str(body.get("exportType", "none")).lower(), body.get("exportFile"), body.get("schedule"), bool(body.get("stopOnFailure", True)))


_DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _later(at: datetime, n: int, unit: str) -> datetime:
    """``n`` units after a time; a day that the month lacks becomes its last one."""
    if unit not in ("month", "year"):
        return at + timedelta(**{f"{unit}s": n})
    months = at.month - 1 + n * (12 if unit == "year" else 1)
    year, month = at.year + months // 12, months % 12 + 1
    return at.replace(year=year, month=month, day=min(at.day, calendar.monthrange(year, month)[1]))


def _moment(text: str, now: datetime) -> datetime:
    """``HH:MM:SS`` of today, or a date and time."""
    return datetime.fromisoformat(text if "-" in text else f"{now:%Y-%m-%d} {text}")


def _cron_field(text: str, low: int, high: int, names: list[str], base: int) -> set[int]:
    """The values that a cron field allows."""
    value = lambda x: names.index(x) + base if x in names else int(x)
    out: set[int] = set()
    for part in text.split(","):
        part, _, step = part.partition("/")
        if part in ("*", "?"):
            a, b = low, high
        elif "-" in part:
            a, b = map(value, part.split("-"))
        else:
            a = value(part)
            b = high if step else a
        span = range(a, b + 1) if a <= b else [*range(a, high + 1), *range(low, b + 1)]
        out.update(list(span)[:: int(step or 1)])
    if not out or not all(low <= x <= high for x in out):
        raise ValueError(f"not a field of a schedule: {text}")
    return out


def cron_next(text: str, now: datetime) -> datetime | None:
    """The first time after ``now`` of a cron line: second, minute, hour, day, month, day of the week (1 is Sunday) and maybe a year."""
    fields = text.split()
    if len(fields) not in (6, 7):
        raise ValueError(f"not a schedule: {text}")
    second, minute, hour, day, month = (_cron_field(f, a, b, _MONTHS if a == 1 and b == 12 else [], 1) for f, (a, b) in zip(fields, [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12)], strict=False))
    weekday = _cron_field(fields[5], 1, 7, _DAYS, 1)
    year = _cron_field(fields[6], 1970, 2199, [], 0) if len(fields) == 7 else set(range(now.year, now.year + 9))
    at = now.replace(microsecond=0) + timedelta(seconds=1)
    for _ in range(366 * 9):
        if at.year in year and at.month in month and at.day in day and (at.weekday() + 1) % 7 + 1 in weekday:
            for h in sorted(x for x in hour if x >= at.hour):
                for m in sorted(x for x in minute if (h, x) >= (at.hour, at.minute)):
                    for s in sorted(x for x in second if (h, m, x) >= (at.hour, at.minute, at.second)):
                        return at.replace(hour=h, minute=m, second=s)
        at = (at + timedelta(days=1)).replace(hour=0, minute=0, second=0)
    return None


def next_run(schedule: str, now: datetime, first: bool) -> datetime | None:
    """When a job runs next; None for never.

    ``every 10 second|minute|hour|day|week|month|year [starts 'time'] [ends 'time']``,
    ``every 'HH:MM:SS' on mon,wed``, ``after 5 minute``, ``at '[date] HH:MM:SS'``, or a cron
    line in parentheses.
    """
    s = re.sub(r"[\"']", "", schedule.strip().lower())
    unit = r"(second|minute|hour|day|week|month|year)s?"
    time_ = r"((?:\d{4}-\d\d-\d\d )?\d\d:\d\d:\d\d)"
    if m := re.fullmatch(rf"every\s+(\d+)\s*{unit}(?:\s+starts\s+{time_})?(?:\s+ends\s+{time_})?", s):
        at = now if first else _later(now, int(m[1]), m[2])
        at = max(at, _moment(m[3], now)) if m[3] else at
        return at if not m[4] or at <= _moment(m[4], now) else None
    if m := re.fullmatch(r"every\s+(\d\d):(\d\d):(\d\d)\s+on\s+([a-z, ]+)", s):
        return cron_next(f"{int(m[3])} {int(m[2])} {int(m[1])} ? * {m[4].replace(' ', '')}", now)
    if m := re.fullmatch(rf"after\s+(\d+)\s*{unit}", s):
        return _later(now, int(m[1]), m[2]) if first else None
    if m := re.fullmatch(rf"at\s+{time_}", s):
        if not first:
            return None
        at = _moment(m[1], now)
        return at if "-" in m[1] or at >= now else at + timedelta(days=1)
    if m := re.fullmatch(r"\((.*)\)", s):
        return cron_next(m[1], now)
    raise ValueError(f"not a schedule: {schedule}")


class Jobs:
    def __init__(self, session):
        self.session, self.jobs, self.ids = session, {}, itertools.count(1)

    def commit(self, job: Job, wait: bool = True) -> int:
        for t in job.tasks:
            if t.get("taskType", "").lower() not in ("sql", "query", "python"):
                raise ValueError(f"no such kind of task: {t.get('taskType')}")
        number = next(self.ids)
        self.jobs[number] = job
        if job.schedule:
            threading.Thread(target=self._scheduled, args=(job,), daemon=True).start()
        elif wait:
            self.run(job)
        else:
            threading.Thread(target=self.run, args=(job,), daemon=True).start()
        return number

    def _scheduled(self, job: Job) -> None:
        first = True
        while job.state != "CLOSED" and (at := next_run(job.schedule, datetime.now(), first)):
            if job.state != "PARTIALLY_FAILING":
                job.state = "IDLE"
            while datetime.now() < at and job.state != "CLOSED":
                time.sleep(0.05)
            if job.state != "CLOSED":
                self.run(job)
            if job.state == "FAILED":
                return
            first = False
        if job.state == "PARTIALLY_FAILING":
            job.state = "PARTIALLY_FAILED"

    def run(self, job: Job) -> None:
        from .udf.adapter import transform

        job.state, df = "RUNNING", None
        try:
            for t in job.tasks:
                kind = t["taskType"].lower()
                if kind != "python":
                    for sql in t.get("sqlList", [t.get("sql")]):
                        df = self.session.sql(sql)
                else:
                    function, schema = self.session.transforms[t["pyTaskName"]]
                    df = transform(function, df, schema(df) if callable(schema) else schema, t.get("dataFlowType", "batch").lower() == "batch")
            if job.export == "file" and df is not None:
                df.write.mode("overwrite").csv(job.file, header=True)
            elif job.export == "store" and df is not None:
                self.session.store.insert(df)
            job.result, job.state, job.error = df, "FINISHED", None
        except Exception as e:  # the job's state carries what went wrong
            # A job that goes on after a failure has failed in part; a later run that ends well clears that.
            job.error = str(e)
            job.state = "FAILED" if job.stop_on_failure else "PARTIALLY_FAILING" if job.schedule else "PARTIALLY_FAILED"
        job.runs += 1

    def cancel(self, number: int) -> None:
        self.jobs[number].state = "CLOSED"
