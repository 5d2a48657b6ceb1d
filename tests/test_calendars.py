"""Recurrence, busy ranges and calendar text against hand-made expectations and plain loops."""

from datetime import date, datetime, timedelta, timezone

import pytest

from loomfield.sources import calendars


def ics(*events, zone=""):
    return "BEGIN:VCALENDAR\r\n" + zone + "".join("BEGIN:VEVENT\r\n" + "".join(f"{line}\r\n" for line in e) + "END:VEVENT\r\n" for e in events) + "END:VCALENDAR\r\n"


def at(*x):
    return datetime(*x, tzinfo=timezone.utc)


def ranges(spark, text, since, until, **options):
    found = calendars.read_events(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    rows = calendars.busy_ranges(found, "k", since, until, **options).orderBy("start", "end").collect()
    utc = lambda x: x.astimezone(timezone.utc)
    return [(utc(r.start), utc(r.end), r.summary) for r in rows]


def starts(spark, text, since, until):
    return [a for a, *_ in ranges(spark, text, since, until, merge=False)]


def test_a_daily_rule_of_many_years_meets_a_late_window(spark):
    got = starts(spark, ics(["UID:a", "DTSTART:19700101T060000Z", "DURATION:PT1H", "RRULE:FREQ=DAILY"]), at(2026, 1, 1), at(2026, 1, 6))
    assert got == [at(2026, 1, d, 6) for d in range(1, 6)]
    counted = ics(["UID:a", "DTSTART:20200101T060000Z", "DURATION:PT1H", "RRULE:FREQ=DAILY;COUNT=10"])
    assert starts(spark, counted, at(2020, 1, 8), at(2020, 2, 1)) == [at(2020, 1, d, 6) for d in (8, 9, 10)]
    weekly = ics(["UID:a", "DTSTART:20010102T060000Z", "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,TH"])
    want = [d for k in range(0, 9200) if (d := date(2001, 1, 2) + timedelta(days=k)).weekday() in (1, 3) and (d - date(2001, 1, 1)).days // 7 % 2 == 0 and date(2026, 1, 1) <= d < date(2026, 3, 1)]
    assert [x.date() for x in starts(spark, weekly, at(2026, 1, 1), at(2026, 3, 1))] == want


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("FREQ=MONTHLY;BYDAY=2TU", [date(2026, 1, 5), date(2026, 1, 13), date(2026, 2, 10), date(2026, 3, 10)]),
        ("FREQ=MONTHLY;BYDAY=-1FR;COUNT=3", [date(2026, 1, 5), date(2026, 1, 30), date(2026, 2, 27)]),
        ("FREQ=MONTHLY;BYMONTHDAY=-1,15", [date(2026, 1, 5), date(2026, 1, 15), date(2026, 1, 31), date(2026, 2, 15), date(2026, 2, 28), date(2026, 3, 15), date(2026, 3, 31)]),
        ("FREQ=MONTHLY;BYMONTHDAY=13;BYDAY=FR", [date(2026, 1, 5), date(2026, 2, 13), date(2026, 3, 13)]),
        ("FREQ=YEARLY;BYMONTH=3;BYDAY=1MO", [date(2026, 1, 5), date(2026, 3, 2)]),
        ("FREQ=YEARLY;BYDAY=1MO", [date(2026, 1, 5), date(2026, 2, 2), date(2026, 3, 2)]),
        ("FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE;UNTIL=20260121T235959Z", [date(2026, 1, 5), date(2026, 1, 7), date(2026, 1, 19), date(2026, 1, 21)]),
        ("FREQ=HOURLY", [date(2026, 1, 5)]),
    ],
)
def test_rules(spark, rule, want):
    got = starts(spark, ics(["UID:a", "DTSTART:20260105T090000Z", "DURATION:PT1H", f"RRULE:{rule}"]), at(2026, 1, 1), at(2026, 4, 1))
    assert [x.date() for x in got] == want


def test_exceptions_overrides_and_additions(spark):
    master = ["UID:a", "SUMMARY:Class", "DTSTART:20260105T090000Z", "DURATION:PT1H", "RRULE:FREQ=DAILY;COUNT=5", "EXDATE:20260106T090000Z", "RDATE:20260120T090000Z,20260121T090000Z/PT2H"]
    moved = ["UID:a", "SUMMARY:Moved", "RECURRENCE-ID:20260107T090000Z", "DTSTART:20260107T150000Z", "DURATION:PT1H"]
    off = ["UID:a", "STATUS:CANCELLED", "RECURRENCE-ID:20260108T090000Z", "DTSTART:20260108T090000Z", "DURATION:PT1H"]
    free = ["UID:b", "TRANSP:TRANSPARENT", "DTSTART:20260110T090000Z", "DURATION:PT1H"]
    nameless = ["DTSTART:20260105T090000Z", "RECURRENCE-ID:20260105T090000Z"]
    text = ics(master, moved, off, free, nameless)
    got = ranges(spark, text, at(2026, 1, 1), at(2026, 2, 1), merge=False)
    assert [(a.day, a.hour, s) for a, _, s in got if s] == [(5, 9, "Class"), (7, 15, "Moved"), (9, 9, "Class"), (20, 9, "Class"), (21, 9, "Class")]
    assert len(ranges(spark, text, at(2026, 1, 1), at(2026, 2, 1), merge=False, transparent=True, cancelled=True)) == len(got) + 2


def test_wall_clock_length_across_a_change_of_the_clocks(spark):
    # three nights, with an hour less in the second one
    text = ics(["UID:a", "DTSTART;TZID=Europe/Oslo:20260327T150000", "DTEND;TZID=Europe/Oslo:20260330T110000", "RRULE:FREQ=WEEKLY;COUNT=2"])
    assert ranges(spark, text, at(2026, 3, 1), at(2026, 5, 1)) == [(at(2026, 3, 27, 14), at(2026, 3, 30, 9), None), (at(2026, 4, 3, 13), at(2026, 4, 6, 9), None)]
    until = ics(["UID:a", "DTSTART;TZID=Europe/Oslo:20260302T100000", "DURATION:PT3H", "RRULE:FREQ=WEEKLY;BYDAY=MO;UNTIL=20260330T080000Z"])
    assert [(x.day, x.hour) for x in starts(spark, until, at(2026, 3, 1), at(2026, 5, 1))] == [(2, 9), (9, 9), (16, 9), (23, 9), (30, 8)]


def test_zones_that_only_the_calendar_explains(spark):
    zone = "BEGIN:VTIMEZONE\r\nTZID:Own Time\r\nBEGIN:STANDARD\r\nDTSTART:19700101T000000\r\nTZOFFSETFROM:+0200\r\nTZOFFSETTO:+0300\r\nEND:STANDARD\r\nEND:VTIMEZONE\r\n"
    text = ics(["UID:a", "DTSTART;TZID=Own Time:20260105T090000", "DURATION:PT1H", "RRULE:FREQ=DAILY;COUNT=3"], zone=zone)
    assert starts(spark, text, at(2026, 1, 1), at(2026, 2, 1)) == [at(2026, 1, d, 6) for d in (5, 6, 7)]


def test_merged_ranges_tell_their_summaries(spark):
    text = ics(*[[f"UID:{k % 2}", *([f"SUMMARY:{s}"] if s else []), f"DTSTART:2026010{d}", "DURATION:P1D"] for k, (s, d) in enumerate([("A", 1), ("A", 2), ("B", 3), (None, 4), ("C", 7)])])
    found = calendars.read_events(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    rows = calendars.busy_ranges(found, "k", at(2026, 1, 1), at(2026, 2, 1)).orderBy("start").collect()
    assert [(r.n, r.summary, r.uid, r.all_day) for r in rows] == [(4, "A; B", None, True), (1, "C", "0", True)]
    with pytest.raises(calendars.CalendarError):
        calendars.busy_ranges(found, "k", at(2026, 1, 1), at(2026, 1, 1))


def test_rules_in_words():
    start = datetime(2026, 3, 4, 10)
    say = lambda rule: calendars.rule_text(calendars.parse_rule(rule), start)
    assert say("FREQ=DAILY") == "every day"
    assert say("FREQ=DAILY;INTERVAL=3;COUNT=1") == "every 3 days, 1 time"
    assert say("FREQ=WEEKLY") == "every week on Wednesday"
    assert say("FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE,FR;UNTIL=20260601") == "every 2 weeks on Monday, Wednesday and Friday until 2026-06-01"
    assert say("FREQ=MONTHLY") == "every month on the 4th"
    assert say("FREQ=MONTHLY;BYMONTHDAY=1,15") == "every month on the 1st and the 15th"
    assert say("FREQ=MONTHLY;BYDAY=-1FR;COUNT=12") == "every month on the last Friday, 12 times"
    assert say("FREQ=YEARLY") == "every year on 4 March"
    assert say("FREQ=YEARLY;BYMONTH=6,7") == "every year in June and July on the 4th"
    assert say("FREQ=YEARLY;BYMONTH=11;BYDAY=4TH") == "every year on the 4th Thursday of November"
    assert say("FREQ=WEEKLY;BYDAY=MO;BYSETPOS=1") is None and say("FREQ=HOURLY") is None
    for bad in ("INTERVAL=2", "FREQ=WEEKLY;BYDAY=XX"):
        with pytest.raises(calendars.CalendarError):
            calendars.parse_rule(bad)


def test_calendar_text(spark):
    events = [
        ["SUMMARY:Stay\\, long", "UID:u1", "DTSTART;VALUE=DATE:20260306", "DTEND;VALUE=DATE:20260310", "STATUS:confirmed", "DESCRIPTION:One\\nTwo"],
        ["SUMMARY:Clean", "DTSTART;TZID=Europe/Oslo:20260302T100000", "DTEND;TZID=Europe/Oslo:20260302T130000", "RRULE:FREQ=WEEKLY;BYDAY=MO", "EXDATE;TZID=Europe/Oslo:20260316T100000", "ORGANIZER;CN=Kim:mailto:kim@x.example", "CATEGORIES:a,b", "TRANSP:TRANSPARENT"],
        ["DTSTART:20260315T090000Z", "DURATION:P2D"],
    ]
    text = ics(*events, zone="X-WR-CALNAME:Cabin\r\n")
    got = calendars.read_calendar_texts(spark.createDataFrame([(1, text), (2, "BEGIN:VCALENDAR"), (3, None)], "k int, t string"), "k", "t").collect()
    assert [r.k for r in got] == [1, 2] and got[1].error and got[1].text is None
    assert got[0].text == (
        "Calendar: Cabin\nEvents: 3\n\nEvent: Stay, long\n  Starts: 2026-03-06 (all day)\n  Ends: 2026-03-10 (exclusive: last day is 2026-03-09)\n  Length: 4 days\n  Status: CONFIRMED\n  Description:\n    One\n    Two\n\n"
        "Event: Clean\n  Starts: 2026-03-02 10:00 (Europe/Oslo)\n  Ends: 2026-03-02 13:00 (Europe/Oslo)\n  Length: 3 hours\n  Repeats: every week on Monday (RRULE:FREQ=WEEKLY;BYDAY=MO)\n"
        "  Except: 2026-03-16 10:00 (Europe/Oslo)\n  Shows as: free (does not block time)\n  Organizer: Kim <kim@x.example>\n  Categories: a, b\n\nEvent: (untitled)\n  Starts: 2026-03-15 09:00 UTC\n  Duration: P2D\n  Length: 2 days"
    )
    each = calendars.read_event_texts(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", "Booking", uid=True, description=False).collect()
    assert [r.label for r in each] == ["Booking 1", "Booking 2", "Booking 3"] and each[0].text.endswith("UID: u1") and "One" not in each[0].text


def test_calendars_read_and_expanded_in_one_step(spark, tmp_path):
    """As in two steps: moved ones by a folded name and from another row of the key, errors, nulls and zones."""
    lines = lambda *x: ["UID:a", "SUMMARY:Class", "DURATION:PT1H", *x]
    weekly = lines("DTSTART:20260105T090000Z", "RRULE:FREQ=DAILY;COUNT=4", "EXDATE:20260106T090000Z")
    zone = "BEGIN:VTIMEZONE\r\nTZID:Own\r\nBEGIN:STANDARD\r\nTZOFFSETTO:+0300\r\nEND:STANDARD\r\nEND:VTIMEZONE\r\n"
    texts = [
        (1, ics(weekly)), (2, ics(weekly, lines("RECUR\r\n RENCE-ID:20260107T090000Z", "DTSTART:20260109T090000Z"))), (1, ics(lines("RECURRENCE-ID:20260108T090000Z", "DTSTART:20260110T090000Z", "STATUS:CANCELLED"))),
        (3, ics(["UID:b"])), (4, None), (5, ics(lines("DTSTART;TZID=Own:20260105T090000"), zone=zone)), (6, ics(lines("DTSTART;TZID=Own:20260105T090000"))), (7, ics(lines("DTSTART:20260105T090000Z", "TRANSP:TRANSPARENT"))),
    ]
    rows = spark.createDataFrame(texts, "k int, t string")
    window = at(2026, 1, 1), at(2026, 2, 1)
    for given in (rows, rows.where("k in (5, 6)")):
        for options in ({"merge": False}, {"merge": True}, {"merge": False, "transparent": True, "cancelled": True}):
            two = calendars.busy_ranges(calendars.read_events(given, "k", "t"), "k", *window, **options)
            one = calendars.calendar_ranges(given, "k", "t", *window, **options)
            assert one.schema == two.schema and sorted(map(str, one.collect())) == sorted(map(str, two.collect())) != []
    with pytest.raises(calendars.CalendarError):
        calendars.calendar_ranges(rows, "k", "t", at(2026, 1, 1), at(2026, 1, 1))


def test_calendars_of_one_split_are_dealt_out_and_parsed_once(spark, tmp_path):
    path = str(tmp_path / "calendars.parquet")
    spark.range(2000).selectExpr("id AS k", f"replace('{ics(['UID:a', 'DTSTART:20260105T090000Z', 'DURATION:PT1H', 'RRULE:FREQ=WEEKLY;COUNT=4'])}', 'UID:a', 'UID:' || sha2(cast(id AS string), 256)) AS t").coalesce(1).write.parquet(path)
    found = calendars.calendar_ranges(spark.read.parquet(path), "k", "t", at(2026, 1, 1), at(2027, 1, 1), merge=False)
    assert found.rdd.getNumPartitions() >= 8
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert found.count() == 8000
