"""Recurring time windows ("Mon-Fri 3-5pm & Sun all day") and their status at an instant, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
#: End of a window that lasts until closing time when that is unknown.
LAST = DAY - 1
_DAYS = "mon|tue|wed|thu|fri|sat|sun"
_WINDOW = "struct<start_day:int,end_day:int,start_min:int,end_min:int,spans:boolean,close:boolean,all_day:boolean>"
_RANGE = r"^(\d{1,2})(?::(\d{2}))?(am|pm)?\s*-\s*(close|midnight|(\d{1,2})(?::(\d{2}))?(am|pm)?)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` written, and computed, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def _groups(text: Column, pattern: str) -> Column:
    """The groups of a pattern that fits the whole text, as an array from 1 on; searched for once."""
    return F.split(F.regexp_replace(text, pattern, "|$1|$2|$3|$4|$5|$6|$7"), r"\|")


def to_minutes(hour: Column, minute: Column, half: Column) -> Column:
    """Minutes of the day: 12am is 0, 12pm noon; hours aren't checked for range."""
    h = F.when((half == "am") & (hour == 12), 0).when((half == "pm") & (hour != 12), hour + 12).otherwise(hour)
    return h * 60 + minute


def day_number(token: Column) -> Column:
    """1 to 7 from Monday, by the first three letters."""
    return F.array_position(F.array(*[F.lit(d) for d in _DAYS.split("|")]), F.lower(token)).cast("int")


def day_range(token: Column) -> Column:
    """struct(start_day, end_day) of "Daily", "Fri" or "Thu-Sat"; null for anything else, full names included."""
    t = F.lower(token)
    a, b = F.regexp_extract(t, rf"^({_DAYS})", 1), F.regexp_extract(t, rf"-({_DAYS})$", 1)
    days = F.struct(day_number(a).alias("start_day"), day_number(F.when(b == "", a).otherwise(b)).alias("end_day"))
    return F.when(t == "daily", F.struct(F.lit(1).alias("start_day"), F.lit(7).alias("end_day"))).when(t.rlike(rf"^({_DAYS})(-({_DAYS}))?$"), days)


def _or(c: Column, *others: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *others)], F.lit("pm"))


def time_range(token: Column) -> Column:
    """struct(start_min, end_min, spans, close, all_day) of "4-6pm", "3-close", "all day"; null if it can't be read. A
    start or end without am or pm takes the other rule: the start pm, the end that of the start."""
    def fields(start: Column, end: Column, over: Column, close: Column, whole: bool) -> Column:
        return F.struct(start.cast("int").alias("start_min"), end.cast("int").alias("end_min"), over.alias("spans"), close.alias("close"), F.lit(whole).alias("all_day"))

    def read(g: Column) -> Column:
        close = g[4] == "close"
        start = to_minutes(_number(g[1]), _number(g[2]), _or(g[3]))
        end = F.when(close, LAST).otherwise(to_minutes(_number(g[5]), _number(g[6]), _or(g[7], g[3])))
        return let(F.struct(start.alias("s"), end.alias("e"), close.alias("c")), lambda x: fields(x["s"], F.when(x["e"] <= x["s"], x["e"] + DAY).otherwise(x["e"]), x["e"] <= x["s"], x["c"], False))

    def known(t: Column) -> Column:
        all_day = fields(F.lit(0), F.lit(LAST), F.lit(False), F.lit(False), True)
        return F.when(t == "all day", all_day).when(t.rlike(_RANGE + "$") & ~t.endswith("midnight"), let(_groups(t, _RANGE + "$"), read))

    return let(F.lower(F.trim(token)), known)


def parse_hours(hours: Column) -> Column:
    """The windows of a text in their order. Segments part at & and comma; one without a day takes the days of the
    segment before it, even if that one's time couldn't be read. Segments that can't be read are passed over; null and
    blank have none."""

    def segment_parts(segment: Column) -> Column:
        """struct(own, text, t): a segment's own days, its time as text and as read."""
        words = F.filter(F.split(F.trim(segment), r"\s+"), lambda w: w != "")
        split = let(words, lambda w: let(day_range(F.get(w, F.lit(0))), lambda own: F.struct(own.alias("own"), F.when(own.isNotNull(), F.array_join(F.slice(w, F.lit(2), F.size(w)), " ")).otherwise(F.array_join(w, " ")).alias("text"))))
        return let(split, lambda x: F.struct(x["own"].alias("own"), x["text"].alias("text"), time_range(x["text"]).alias("t")))

    def step(acc: Column, x: Column) -> Column:
        days, t = F.coalesce(x["own"], acc["last"]), x["t"]
        window = F.struct(days["start_day"].alias("start_day"), days["end_day"].alias("end_day"), *[t[n].alias(n) for n in ("start_min", "end_min", "spans", "close", "all_day")])
        added = F.when(days.isNotNull() & t.isNotNull(), F.concat(acc["windows"], F.array(window))).otherwise(acc["windows"])
        last = F.when(days.isNotNull() & (x["text"] != ""), days).otherwise(acc["last"])
        return F.struct(last.alias("last"), added.cast(f"array<{_WINDOW}>").alias("windows"))

    zero = F.struct(F.lit(None).cast("struct<start_day:int,end_day:int>").alias("last"), F.array().cast(f"array<{_WINDOW}>").alias("windows"))
    return F.aggregate(F.transform(F.split(F.coalesce(hours, F.lit("")), "[&,]"), segment_parts), zero, step, lambda acc: acc["windows"])


def parse_business_hours(text: Column) -> Column:
    """Closing minutes by day (an array of seven from Monday, null where unknown). Segments part at commas; closed days
    and what can't be read are left out, a later segment replaces an earlier one for its days. Midnight is 1440."""
    head = rf"(?i)^(daily|(?:{_DAYS})(?:-(?:{_DAYS}))?)\s+(.+)$"
    inner = _RANGE.removeprefix("^")
    range_only = rf"(?s)^.*?(?:{inner}).*$"

    def body_of(s: Column) -> Column:
        """struct(days, end) of a segment; null where it can't be read."""
        days, body = day_range(F.regexp_extract(s, head, 1)), F.lower(F.trim(F.regexp_extract(s, head, 2)))
        return let(F.struct(days.alias("days"), body.alias("body")), lambda x: F.when(x["days"].isNotNull() & ~x["body"].startswith("closed") & x["body"].rlike(inner), F.struct(x["days"].alias("days"), let(_groups(x["body"], range_only), ends).alias("end"))))

    def ends(g: Column) -> Column:
        return F.when(g[4] == "midnight", DAY).when(g[4] == "close", LAST).otherwise(to_minutes(_number(g[5]), _number(g[6]), _or(g[7], g[3]))).cast("int")

    def step(acc: Column, x: Column) -> Column:
        return F.when(x.isNull(), acc).otherwise(F.transform(acc, lambda old, i: F.when(day_in(i + 1, x["days"]["start_day"], x["days"]["end_day"]), x["end"]).otherwise(old)))

    zero = F.array(*[F.lit(None).cast("int")] * 7)
    return F.aggregate(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: let(F.trim(s), body_of)), zero, step)


def day_in(day: Column, start: Column, end: Column) -> Column:
    """Whether a day is in a range that may run over Sunday."""
    return F.when(end >= start, (day >= start) & (day <= end)).otherwise((day >= start) | (day <= end))


def day_before(day: Column) -> Column:
    return F.when(day == 1, 7).otherwise(day - 1)


def status(hours: Column, business: Column, now: Column) -> Column:
    """struct(kind, next_start_min, end_min) at a timestamp: live with its end, soon (a start within two hours today),
    closed, or unknown without windows. The first active window in the text's order gives the end; one that lasts
    until closing takes today's closing time."""
    day, minute = F.weekday(now) + 1, F.hour(now) * 60 + F.minute(now)
    null = F.lit(None).cast("int")

    def settled(w: Column, closing: Column) -> Column:
        end = F.when(w["close"] & closing.isNotNull(), F.when(closing <= w["start_min"], closing + DAY).otherwise(closing)).otherwise(w["end_min"])
        today = day_in(day, w["start_day"], w["end_day"])
        spill = (end > DAY) & day_in(day_before(day), w["start_day"], w["end_day"]) & (minute < end - DAY)
        active = (today & (minute >= w["start_min"]) & (minute < F.least(end, F.lit(DAY)))) | spill
        wait = F.when(today & (minute < w["start_min"]) & (w["start_min"] - minute <= 120), w["start_min"])
        return F.struct(active.alias("active"), F.when(spill, end - DAY).otherwise(end).cast("int").alias("end"), wait.cast("int").alias("wait"))

    kind = lambda k, a, b: F.struct(F.lit(k).alias("kind"), a.alias("next_start_min"), b.alias("end_min"))

    def judged(seen: Column) -> Column:
        found = F.get(F.filter(seen, lambda w: w["active"]), F.lit(0))
        soon = F.array_min(F.transform(seen, lambda w: w["wait"]))
        return F.when(F.size(seen) == 0, kind("unknown", null, null)).when(found.isNotNull(), kind("live", null, found["end"])).when(soon.isNotNull(), kind("soon", soon, null)).otherwise(kind("closed", null, null))

    return let(F.get(parse_business_hours(business), day - 1), lambda closing: let(F.transform(parse_hours(hours), lambda w: settled(w, closing)), judged))


def time_until(start: Column, now: Column) -> Column:
    """"1h 5m" or "5m" until a minute of the day; empty if it has passed."""
    left = start - (F.hour(now) * 60 + F.minute(now))
    h, m = F.floor(left / 60).cast("string"), (left % 60).cast("string")
    return F.when(left <= 0, "").when(left >= 60, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))
