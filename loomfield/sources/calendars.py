"""iCalendar events, recurrence, busy ranges and their text.

A rule is expanded inside a window: what lies before it counts for COUNT and is neither kept nor shipped, and the
ceiling ``MAX_OCCURRENCES`` holds for occurrences in the window.  An occurrence keeps its wall-clock length across
a change of the clocks.
"""

from __future__ import annotations

import re
from calendar import month_name, monthrange
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.feeds import put, tidy
from loomfield.sources.rows import FLUSH, explode_text, spread
from loomfield.streaming.windows import overlapping

MAX_OCCURRENCES, MAX_PERIODS = 20_000, 200_000
DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
EVENT = (
    "uid string, summary string, description string, location string, status string, transparency string, all_day boolean, start_wall timestamp_ntz, start_zone string, start_utc timestamp, "
    "end_utc timestamp, rule string, recurrence_id timestamp, added array<timestamp>, excluded array<timestamp>, span_seconds double, fixed_offset double, added_wall array<timestamp_ntz>"
)
DAY = timedelta(days=1)
#: The widest distance between a zone's wall clock and UTC, and some room.
SLACK = timedelta(hours=26)


class CalendarError(ValueError):
    pass


def unfold(text: str) -> list[tuple[int, str]]:
    """Logical lines with the number of their first line."""
    out: list[tuple[int, str]] = []
    for n, line in enumerate(re.split(r"\r\n|\n|\r", text), 1):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + line[1:])
        elif line:
            out.append((n, line))
    return out


def unescape(value: str) -> str:
    return re.sub(r"\\([nN\;,])", lambda m: "\n" if m[1] in "nN" else m[1], value)


def split_values(value: str) -> list[str]:
    return [x for x in re.split(r"(?<!\\),", value) if x]


#: Lines and times repeat from calendar to calendar; longer ones aren't remembered.
_SHORT, _REMEMBERED = 200, 16_384
_LINE = re.compile(r"""([A-Za-z0-9-]+)((?:;[A-Za-z0-9-]+=(?:"[^"]*"|[^";:]*)(?:,(?:"[^"]*"|[^";:]*))*)*):(.*)""", re.S)


@lru_cache(_REMEMBERED)
def _property(line: str) -> tuple[str, dict, str] | None:
    """(name, parameters, value), which nobody changes."""
    m = _LINE.fullmatch(line)
    if not m:
        return None
    return m[1].upper(), {k.upper(): v.strip('"') for k, _, v in (p.partition("=") for p in re.findall(r""";([^=;]+=(?:"[^"]*"|[^;])*)""", m[2]))}, m[3]


def components(text: str) -> dict:
    """Nested components: name, properties (name, parameters, value, line) and children."""
    root: dict = {"name": "", "properties": [], "children": []}
    stack = [root]
    for n, line in unfold(text.removeprefix("﻿")):
        found = _property(line) if len(line) <= _SHORT else _property.__wrapped__(line)
        if not found:
            raise CalendarError(f"line {n}: no property")
        name, parameters, value = found
        if name == "BEGIN":
            stack[-1]["children"].append(c := {"name": value.strip().upper(), "properties": [], "children": []})
            stack.append(c)
        elif name == "END":
            if len(stack) == 1 or stack[-1]["name"] != value.strip().upper():
                raise CalendarError(f"line {n}: END:{value} closes nothing")
            stack.pop()
        else:
            stack[-1]["properties"].append((name, parameters, value, n))
    if len(stack) > 1:
        raise CalendarError(f"{stack[-1]['name']} isn't closed")
    return root


def wall_time(value: str, parameters: dict, line: int = 0) -> tuple[datetime, bool, str | None]:
    """(wall clock, whether a whole day, zone: UTC, a name or None)."""
    m = re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?(Z)?)?", value.strip())
    if not m:
        raise CalendarError(f"line {line}: {value!r} is no date")
    try:
        wall = datetime(*(int(x or 0) for x in m.groups()[:5]), min(59, int(m[6] or 0)))
    except ValueError as e:
        raise CalendarError(f"line {line}: {e}") from None
    return wall, m[4] is None, "UTC" if m[7] else parameters.get("TZID") if m[4] else None


def duration(value: str, line: int = 0) -> timedelta:
    m = re.fullmatch(r"([+-])?P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", value.strip())
    if not m or not any(m.groups()[1:]):
        raise CalendarError(f"line {line}: {value!r} is no duration")
    w, d, h, mi, s = (int(x or 0) for x in m.groups()[1:])
    return timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=s) * (-1 if m[1] == "-" else 1)


def instant(wall: datetime, zone: str | None, offsets: dict[str, timedelta]) -> datetime:
    """UTC; an unknown zone uses the calendar's own standard offset, else floats as UTC."""
    if zone in (None, "UTC"):
        return wall.replace(tzinfo=timezone.utc)
    try:
        return wall.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
    except (KeyError, ValueError, OSError):
        return (wall - offsets.get(zone, timedelta())).replace(tzinfo=timezone.utc)


def parse_rule(value: str, line: int = 0) -> dict:
    parts = dict(p.upper().split("=", 1) for p in value.strip().split(";") if "=" in p)
    if "FREQ" not in parts:
        raise CalendarError(f"line {line}: a rule needs FREQ")
    rule: dict = {"freq": parts.pop("FREQ"), "interval": int(parts.pop("INTERVAL", 1)), "count": int(parts["COUNT"]) if "COUNT" in parts else None, "until": parts.pop("UNTIL", None), "wkst": parts.pop("WKST", "MO")}
    parts.pop("COUNT", None)
    if rule["interval"] < 1 or rule["count"] is not None and rule["count"] < 1:
        raise CalendarError(f"line {line}: INTERVAL and COUNT are 1 at least")
    rule["byday"] = []
    for x in parts.pop("BYDAY", "").split(","):
        if m := re.fullmatch(r"([+-]?\d+)?(MO|TU|WE|TH|FR|SA|SU)", x.strip()):
            rule["byday"].append((int(m[1] or 0), DAYS.index(m[2])))
        elif x:
            raise CalendarError(f"line {line}: {x!r} is no BYDAY entry")
    for name in ("BYMONTHDAY", "BYMONTH", "BYSETPOS"):
        rule[name.lower()] = [int(x) for x in parts.pop(name, "").split(",") if x]
    rule["other"] = parts
    return rule


def _days_of_month(rule: dict, year: int, month: int, start: datetime) -> list[int]:
    n = monthrange(year, month)[1]
    by_date = {d if d > 0 else n + 1 + d for d in rule["bymonthday"]} if rule["bymonthday"] else None
    by_day = None
    if rule["byday"]:
        by_day = set()
        for nth, wd in rule["byday"]:
            own = [d for d in range(1, n + 1) if date(year, month, d).weekday() == wd]
            by_day |= set(own) if not nth else {own[nth - 1 if nth > 0 else nth]} if abs(nth) <= len(own) else set()
    found = by_date & by_day if by_date is not None and by_day is not None else by_date if by_date is not None else by_day if by_day is not None else {start.day}
    days = sorted(d for d in found if 1 <= d <= n)
    if rule["bysetpos"]:
        days = sorted({days[p - 1 if p > 0 else p] for p in rule["bysetpos"] if abs(p) <= len(days)})
    return days


def _periods(rule: dict, start: datetime) -> Iterator[list[date]]:
    """Each period's days, the first period being that of ``start``."""
    weekdays = {w for _, w in rule["byday"]}
    for period in range(MAX_PERIODS):
        step = period * rule["interval"]
        try:
            if rule["freq"] == "DAILY":
                d = start.date() + timedelta(days=step)
                days = [d] if not weekdays or d.weekday() in weekdays else []
                if rule["bymonthday"]:
                    days = [d for d in days if d.day in rule["bymonthday"] or d.day - 1 - monthrange(d.year, d.month)[1] in rule["bymonthday"]]
            elif rule["freq"] == "WEEKLY":
                first = start.date() - timedelta(days=(start.weekday() - DAYS.index(rule["wkst"])) % 7) + timedelta(weeks=step)
                days = [d for k in range(7) if (d := first + timedelta(days=k)).weekday() in (weekdays or {start.weekday()})]
            else:
                if rule["freq"] == "MONTHLY":
                    month = start.month - 1 + step
                    months = [(start.year + month // 12, month % 12 + 1)]
                else:
                    every = range(1, 13) if rule["byday"] and not rule["bymonthday"] else [start.month]
                    months = [(start.year + step, m) for m in (sorted(rule["bymonth"]) or every)]
                days = [date(y, m, d) for y, m in months for d in _days_of_month(rule, y, m, start)]
        except (ValueError, OverflowError):  # behind the last year there is
            return
        yield [d for d in days if d.month in rule["bymonth"]] if rule["bymonth"] else days


def occurrences(rule: dict, start: datetime, since: datetime | None, stop: datetime, until: datetime | None = None) -> Iterator[datetime]:
    """Wall-clock starts in [since, stop), up to ``until``; the first is always ``start``, whatever the rule says.

    Earlier ones count for COUNT.  Hourly and shorter rules give the start alone.
    """
    given, kept = 1, 0
    if start >= stop:
        return
    if since is None or start >= since:
        kept += 1
        yield start
    if rule["freq"] not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY") or rule["count"] == 1:
        return
    skip = since - start - timedelta(days=1) if since is not None and rule["count"] is None and rule["freq"] in ("DAILY", "WEEKLY") else timedelta()
    if skip > timedelta():
        # without COUNT nothing before the window matters, so whole periods are left out
        length = timedelta(days=rule["interval"] * (7 if rule["freq"] == "WEEKLY" else 1))
        begin = start + max(0, skip // length - 1) * length
    else:
        begin = start
    for days in _periods(rule, begin):
        for d in days:
            at = datetime.combine(d, start.time())
            if at <= start:
                continue
            if at >= stop or until is not None and at > until:
                return
            given += 1
            if since is None or at >= since:
                kept += 1
                yield at
            if given == rule["count"] or kept >= MAX_OCCURRENCES:
                return


def events(text: str) -> Iterator[dict]:
    root = components(text)
    for calendar in [c for c in root["children"] if c["name"] == "VCALENDAR"]:
        offsets: dict[str, timedelta] = {}
        for zone in (c for c in calendar["children"] if c["name"] == "VTIMEZONE"):
            name = next((v for n, _, v, _ in zone["properties"] if n == "TZID"), None)
            standard = next((c for c in zone["children"] if c["name"] == "STANDARD"), None)
            to = next((v for n, _, v, _ in standard["properties"] if n == "TZOFFSETTO"), "") if standard else ""
            if name and (m := re.fullmatch(r"([+-])(\d{2})(\d{2})", to)):
                offsets[name] = timedelta(hours=int(m[2]), minutes=int(m[3])) * (-1 if m[1] == "-" else 1)
        for event in (c for c in calendar["children"] if c["name"] == "VEVENT"):
            one = {n: v for n, _, v, _ in reversed(event["properties"])}
            timed = [x for x in event["properties"] if x[0] in _TIMED]
            brief = not offsets and sum(len(x[2]) for x in timed) <= _SHORT
            try:
                times = _times_of(tuple((n, tuple(p.items()), v) for n, p, v, _ in timed)) if brief else _times(timed, offsets)
            except CalendarError:
                times = _times(timed, offsets)  # tells the line
            words = {c: unescape(one[n]) if n in one else None for c, n in (("summary", "SUMMARY"), ("description", "DESCRIPTION"), ("location", "LOCATION"))}
            yield words | times | {"uid": one.get("UID"), "status": one["STATUS"].upper() if "STATUS" in one else None, "transparency": one["TRANSP"].upper() if "TRANSP" in one else None}


_TIMED = frozenset("DTSTART DTEND DURATION RRULE RECURRENCE-ID RDATE EXDATE".split())


@lru_cache(_REMEMBERED)
def _times_of(timed: tuple) -> dict:
    return _times([(n, dict(p), v, 0) for n, p, v in timed], {})


def _times(properties: list[tuple], offsets: dict[str, timedelta]) -> dict:
    """An event's times by its properties; nobody changes what is found."""
    one = {n: (p, v, k) for n, p, v, k in reversed(properties)}
    if "DTSTART" not in one:
        raise CalendarError("an event has no DTSTART")

    def when(name: str, many: bool = False):
        found = [instant(*(w := wall_time(x, p, k))[::2], offsets) for n, p, v, k in properties if n == name for x in ([y.partition("/")[0] for y in split_values(v)] if many else [v])]  # noqa: F841
        return found if many else next(iter(found), None)

    p, v, k = one["DTSTART"]
    wall, whole, zone = wall_time(v, p, k)
    begin = instant(wall, zone, offsets)
    if "DTEND" in one:
        end_wall, _, end_zone = wall_time(one["DTEND"][1], one["DTEND"][0], one["DTEND"][2])
        span = end_wall - wall if end_zone == zone else instant(end_wall, end_zone, offsets) - begin
    else:
        span = duration(*one["DURATION"][1:]) if "DURATION" in one else DAY if whole else timedelta()
    end = when("DTEND") or begin + (duration(*one["DURATION"][1:]) if "DURATION" in one else timedelta(days=1) if whole else timedelta())
    return {
        "all_day": whole,
        "start_wall": wall,
        "start_zone": zone,
        "start_utc": begin,
        "end_utc": end,
        "rule": one["RRULE"][1] if "RRULE" in one else None,
        "recurrence_id": when("RECURRENCE-ID"),
        "added": when("RDATE", True),
        "excluded": when("EXDATE", True),
        "span_seconds": span.total_seconds(),
        "fixed_offset": offsets[zone].total_seconds() if zone in offsets else None,
        "added_wall": [wall_time(x.partition("/")[0], p, k)[0] for n, p, v, k in properties if n == "RDATE" for x in split_values(v)],
    }


def read_events(rows: DataFrame, key: str, ics: str) -> DataFrame:
    return explode_text(rows, key, ics, events, EVENT)


def expand(event: dict, since: datetime, until: datetime) -> Iterator[tuple[datetime, datetime]]:
    """(start, end) in UTC of the event's occurrences that may meet [since, until), without its excluded ones."""
    wall, zone, span = event["start_wall"], event["start_zone"], timedelta(seconds=event["span_seconds"] or 0)
    offsets = {zone: timedelta(seconds=event["fixed_offset"])} if event["fixed_offset"] is not None else {}
    walls = [wall]
    if event["rule"] is not None:
        rule, last = parse_rule(event["rule"]), None
        if rule["until"]:
            last, whole, last_zone = wall_time(rule["until"], {})
            if whole and not event["all_day"]:
                last += DAY - timedelta(milliseconds=1)
            elif last_zone == "UTC" and zone not in (None, "UTC"):
                known = _known(zone)
                last = last.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) if known else last + offsets.get(zone, timedelta())
        walls = occurrences(rule, wall, since.replace(tzinfo=None) - SLACK - max(span, timedelta()), until.replace(tzinfo=None) + SLACK, last)
    gone, seen = set(event["excluded"] or ()), set()
    for w in (*walls, *(event["added_wall"] or ())):
        begin = instant(w, zone, offsets)
        if begin not in seen and begin not in gone:
            seen.add(begin)
            end = begin + span if event["all_day"] or zone in (None, "UTC") else instant(w + span, zone, offsets)
            yield begin, max(begin, end)


def _known(zone: str) -> bool:
    try:
        return bool(ZoneInfo(zone))
    except (KeyError, ValueError, OSError):
        return False


class _Expanded:
    """Microseconds since 1970 of an event's occurrences; short lists of them are remembered."""

    def __init__(self, since: datetime, until: datetime):
        self.window, self.known = (since, until), {}

    def __call__(self, event: dict) -> list[tuple[int, int]]:
        own = tuple(event[n] for n in _EXPANDED)
        key = (*own, *map(tuple, (event["excluded"] or (), event["added_wall"] or ())))
        if (found := self.known.get(key)) is None:
            found = [((a - _EPOCH) // _MICRO, (b - _EPOCH) // _MICRO) for a, b in expand(event, *self.window)]
            if len(found) <= 32 and len(key[-1]) + len(key[-2]) <= 32:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[key] = found
        return found


_EPOCH, _MICRO = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)
_EXPANDED = ("start_wall", "start_zone", "span_seconds", "fixed_offset", "rule", "all_day")
_OWN = [*_EXPANDED, "excluded", "added_wall"]
#: Moved occurrences that may be sent to all executors.
_FEW = 200_000


def _occurring(rows: DataFrame, key: str, since: datetime, until: datetime, found_in: Callable[[pa.RecordBatch], Iterator[tuple[int, dict]]]) -> DataFrame:
    """(key, uid, summary, all_day, moved, at, end): ``rows``, whose first column is the key, by the events found in their batches."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL("uid string, summary string, all_day boolean, moved boolean, at timestamp, end timestamp").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, expanded = to_arrow_schema(schema), _Expanded(since, until)

        def sent(keys: pa.Array, out: list[tuple]) -> pa.RecordBatch:
            take, *columns, starts, ends = zip(*out, strict=True) if out else [()] * 7
            times = [pa.array(x, pa.int64()).cast(arrow.field("at").type) for x in (starts, ends)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int64())), *(pa.array(x, arrow.field(k).type) for k, x in enumerate(columns, 1)), *times], schema=arrow)

        for batch in batches:
            out: list[tuple] = []
            for k, event in found_in(batch):
                about = k, event["uid"], event["summary"], event["all_day"], bool(event["moved"] if "moved" in event else event["recurrence_id"])
                for begin, end in expanded(event):
                    out.append((*about, begin, end))
                if len(out) >= 4 * FLUSH:
                    yield sent(batch.column(0), out)
                    out = []
            yield sent(batch.column(0), out)

    return rows.mapInArrow(run, schema)


def _checked(since: datetime, until: datetime) -> None:
    if until <= since:
        raise CalendarError("a window must end behind its begin")


def busy_ranges(found: DataFrame, key: str, since: datetime, until: datetime, merge: bool = True, transparent: bool = False, cancelled: bool = False) -> DataFrame:
    """(key, start, end, all_day, summary, uid) of the occurrences of ``read_events`` rows that meet [since, until).

    Moved occurrences replace those of the same uid by an anti join.  Transparent and cancelled events count only
    where asked for.  Merged ranges that overlap or touch have ``n`` of them, their summaries in order, are whole
    days where all are, and keep a uid that all share.
    """
    _checked(since, until)
    live = found.where("error is null")
    counted = live.where((F.lit(transparent) | (F.coalesce("transparency", F.lit("OPAQUE")) != "TRANSPARENT")) & (F.lit(cancelled) | (F.coalesce("status", F.lit("")) != "CANCELLED")))
    slim = counted.select(key, "uid", "summary", F.col("recurrence_id").isNotNull().alias("moved"), *_OWN)
    each = _occurring(slim, key, since, until, lambda batch: enumerate(batch.select(["uid", "summary", "moved", *_OWN]).to_pylist()))
    return _ranges(_unmoved(each, _moved(live, key), key), key, since, until, merge)


def calendar_ranges(rows: DataFrame, key: str, ics: str, since: datetime, until: datetime, merge: bool = True, transparent: bool = False, cancelled: bool = False) -> DataFrame:
    """``busy_ranges`` of calendars that are read and expanded in one step, without those that fail.

    Moved occurrences are looked for only in calendars that name them, and counted: without any there is no join,
    few go to all executors.
    """
    _checked(since, until)
    slim = spread(rows.select(F.col(f"`{key}`"), F.col(f"`{ics}`").alias("__in")))

    def found_in(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
        for k, value in enumerate(batch.column(1)):
            try:
                found = list(events(text)) if (text := value.as_py()) is not None else []
            except Exception:  # ``read_events`` tells it
                continue
            for event in found:
                if (transparent or event["transparency"] != "TRANSPARENT") and (cancelled or event["status"] != "CANCELLED"):
                    yield k, event

    each = _occurring(slim, key, since, until, found_in)
    # a folded name has line breaks and blanks in it
    naming = slim.where(F.translate(F.upper("__in"), "\r\n\t ", "").contains("RECURRENCE-ID"))
    moved = _moved(read_events(naming, key, "__in").where("error is null"), key)
    if not rows.isStreaming:
        n = moved.limit(_FEW + 1).count()
        if not n:
            return _ranges(each, key, since, until, merge)
        moved = F.broadcast(moved) if n <= _FEW else moved
    return _ranges(_unmoved(each, moved, key), key, since, until, merge)


def _moved(live: DataFrame, key: str) -> DataFrame:
    return live.where("recurrence_id is not null and uid is not null").select(F.col(key).alias("__key"), F.col("uid").alias("__uid"), F.col("recurrence_id").alias("__at")).distinct()


def _unmoved(each: DataFrame, moved: DataFrame, key: str) -> DataFrame:
    replaced = each[key].eqNullSafe(moved["__key"]) & (each["uid"] == moved["__uid"]) & (each["at"] == moved["__at"]) & ~each["moved"]
    return each.join(moved, replaced, "left_anti")


def _ranges(left: DataFrame, key: str, since: datetime, until: datetime, merge: bool) -> DataFrame:
    inside = overlapping(left, "at", "end", F.lit(since), F.lit(until))
    if not merge:
        return inside.select(key, F.col("at").alias("start"), "end", "all_day", "summary", "uid")
    order = Window.partitionBy(key).orderBy("at", "end", F.col("summary").asc_nulls_first(), F.col("uid").asc_nulls_first())
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = inside.withColumn("__begins", (before.isNull() | (F.col("at") > before)).cast("int")).withColumn("__island", F.sum("__begins").over(order))
    step = lambda done, s: F.when(s.isNull() | done.eqNullSafe(s), done).when(done.isNull(), s).otherwise(F.concat(done, F.lit("; "), s))
    listed = F.array_sort(F.collect_list(F.struct("at", "end", "summary", "uid")))
    grouped = islands.groupBy(key, "__island").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.bool_and("all_day").alias("all_day"), listed.alias("all"))
    uid = F.when(F.forall("all", lambda x: x["uid"].eqNullSafe(F.col("all")[0]["uid"])), F.col("all")[0]["uid"])
    return grouped.select(key, "start", "end", "n", "all_day", F.aggregate(F.transform("all", lambda x: x["summary"]), F.lit(None).cast("string"), step).alias("summary"), uid.alias("uid"))


NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _nth(n: int) -> str:
    n = abs(n)
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def _listed(words: list[str]) -> str:
    return words[0] if len(words) == 1 else f"{', '.join(words[:-1])} and {words[-1]}"


def date_text(wall: datetime, whole: bool, zone: str | None) -> str:
    """A day, or a day and time with the zone as it is written."""
    if whole:
        return f"{wall:%Y-%m-%d}"
    clock = f"{wall:%H:%M:%S}" if wall.second else f"{wall:%H:%M}"
    return f"{wall:%Y-%m-%d} {clock}" + (" UTC" if zone == "UTC" else f" ({zone})" if zone else "")


def rule_text(rule: dict, start: datetime | None = None) -> str | None:
    """A rule in plain English, or null where it has parts that this doesn't tell."""
    if rule["other"] or rule["bysetpos"] or rule["freq"] not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY"):
        return None
    unit = {"DAILY": "day", "WEEKLY": "week", "MONTHLY": "month", "YEARLY": "year"}[rule["freq"]]
    text = f"every {unit}" if rule["interval"] == 1 else f"every {rule['interval']} {unit}s"
    dates = _listed([f"the {_nth(d)}" if d > 0 else f"{_nth(d)}-to-last day" for d in rule["bymonthday"]]) if rule["bymonthday"] else ""
    days = [NAMES[w] if not n else f"the last {NAMES[w]}" if n == -1 else f"the {_nth(n)}{'-to-last' if n < 0 else ''} {NAMES[w]}" for n, w in rule["byday"]]
    days = _listed(days) if days else ""
    months = _listed([month_name[m] for m in rule["bymonth"]]) if rule["bymonth"] else ""
    if unit in ("day", "week"):
        if dates:
            return None
        on = days or (NAMES[start.weekday()] if unit == "week" and start else "")
    elif unit == "month":
        on = f"{dates} when it falls on {days}" if dates and days else dates or days or (f"the {_nth(start.day)}" if start else "")
    elif months and (days or dates):
        on = f"{days or dates} of {months}"
    elif months:
        text, on = f"{text} in {months}", f"the {_nth(start.day)}" if start else ""
    else:
        on = days or dates or (f"{start.day} {month_name[start.month]}" if start else "")
    text += f" on {on}" if on else ""
    if rule["count"] is not None:
        text += f", {rule['count']} time{'s' if rule['count'] != 1 else ''}"
    return text + (f" until {date_text(*wall_time(rule['until'], {}))}" if rule["until"] else "")


def _length(span: timedelta, whole: bool) -> str:
    minutes = int(span.total_seconds()) // 60
    parts = [(minutes // 1440, "day"), *(() if whole else ((minutes % 1440 // 60, "hour"), (minutes % 60, "minute")))]
    return " ".join(f"{n} {unit}{'s' if n != 1 else ''}" for n, unit in parts if n)


def event_text(event: dict, uid: bool = False, description: bool = True) -> str:
    """A VEVENT component as a block of ``key: value`` lines."""
    one = {n: (v, p, k) for n, p, v, k in reversed(event["properties"])}

    def word(name: str) -> str | None:
        return tidy(unescape(one[name][0])) or None if name in one else None

    def dates(name: str) -> str:
        return ", ".join(date_text(*wall_time(x.partition("/")[0], p, k)) for n, p, v, k in event["properties"] if n == name for x in split_values(v))

    start, end = (wall_time(*one[n]) if n in one else None for n in ("DTSTART", "DTEND"))
    long = duration(one["DURATION"][0], one["DURATION"][2]) if "DURATION" in one else None
    lines = [f"Event: {word('SUMMARY') or '(untitled)'}"]
    told: list[tuple[str, str | None]] = []
    if start:
        told.append(("Starts", date_text(*start) + " (all day)" * start[1]))
    if end:
        told.append(("Ends", date_text(*end) + (f" (exclusive: last day is {date_text(end[0] - DAY, True, None)})" if end[1] else "")))
    elif long is not None:
        told.append(("Duration", one["DURATION"][0].strip()))
    span = end[0] - start[0] if start and end else long
    told.append(("Length", _length(span, bool(start and start[1])) if span and span > timedelta() else None))
    if "RRULE" in one:
        raw, gloss = one["RRULE"][0].strip(), rule_text(parse_rule(one["RRULE"][0], one["RRULE"][2]), start and start[0])
        told.append(("Repeats", f"{gloss} (RRULE:{raw})" if gloss else f"RRULE:{raw}"))
    organizer = re.sub("(?i)^mailto:", "", one["ORGANIZER"][0]).strip() if "ORGANIZER" in one else None
    if organizer is not None and (name := one["ORGANIZER"][1].get("CN")):
        organizer = f"{name} <{organizer}>" if organizer else name
    categories = ", ".join(unescape(x).strip() for n, _, v, _ in event["properties"] if n == "CATEGORIES" for x in split_values(v) if x.strip())
    told += [("Also on", dates("RDATE")), ("Except", dates("EXDATE")), ("Replaces occurrence", dates("RECURRENCE-ID")), ("Location", word("LOCATION")), ("Status", (word("STATUS") or "").upper())]
    told.append(("Shows as", "free (does not block time)" if (word("TRANSP") or "").upper() == "TRANSPARENT" else None))
    told += [("Organizer", organizer), ("Categories", categories), ("URL", one["URL"][0].strip() if "URL" in one else None)]
    told += [("Description", word("DESCRIPTION") if description else None), ("UID", one["UID"][0].strip() if uid and "UID" in one else None)]
    for name, value in told:
        if value:
            put(lines, 1, name, value)
    return "\n".join(lines)


def calendar_events(text: str, **shown: bool) -> Iterator[dict]:
    """Each event's number and text."""
    found = [e for c in components(text)["children"] if c["name"] == "VCALENDAR" for e in c["children"] if e["name"] == "VEVENT"]
    yield from ({"pos": n, "text": event_text(e, **shown)} for n, e in enumerate(found, 1))


def calendar_text(text: str, **shown: bool) -> str:
    """A short head and every event as a block."""
    properties = [p for c in components(text)["children"] if c["name"] == "VCALENDAR" for p in c["properties"]]
    blocks = [e["text"] for e in calendar_events(text, **shown)]
    head: list[str] = []
    for name, key in (("X-WR-CALNAME", "Calendar"), ("X-WR-TIMEZONE", "Time zone")):
        if value := next((tidy(unescape(v)) for n, _, v, _ in properties if n == name), None):
            put(head, 0, key, value)
    put(head, 0, "Events", str(len(blocks)))
    return "\n\n".join(["\n".join(head), *blocks])


def read_calendar_texts(rows: DataFrame, key: str, ics: str, uid: bool = False, description: bool = True) -> DataFrame:
    """(key, text, error): every calendar as one text."""
    return explode_text(rows, key, ics, lambda t: [{"text": calendar_text(t, uid=uid, description=description)}], "text string")


def read_event_texts(rows: DataFrame, key: str, ics: str, label: str = "Event", uid: bool = False, description: bool = True) -> DataFrame:
    """(key, pos, label, text, error): a source for every event."""
    return explode_text(rows, key, ics, lambda t: (e | {"label": f"{label} {e['pos']}"} for e in calendar_events(t, uid=uid, description=description)), "pos int, label string, text string")
