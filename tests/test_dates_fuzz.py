"""Date layouts: random instants rendered in every layout, parsed back."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sluice.functions.text import parse_feed_date

DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def render(t: dt.datetime, layout: str, off_min: int, rng) -> tuple[str, int]:
    """Text of instant ``t`` (UTC) in ``layout`` and the epoch it must parse to."""
    local = t + dt.timedelta(minutes=off_min)
    sign = "-" if off_min < 0 else "+"
    hh, mm = divmod(abs(off_min), 60)
    num = f"{sign}{hh:02d}{mm:02d}"
    colon = f"{sign}{hh:02d}:{mm:02d}"
    epoch = int(t.replace(tzinfo=dt.timezone.utc).timestamp())
    wd, mon = DAYS[local.weekday()], MONTHS[local.month - 1]
    day1 = str(local.day)
    if layout == "rfc1123z":
        return f"{wd}, {local.day:02d} {mon} {local.year} {local.hour:02d}:{local.minute:02d}:{local.second:02d} {num}", epoch
    if layout == "rfc1123":     # zone names count as offset 0
        return f"{wd}, {t.day:02d} {MONTHS[t.month - 1]} {t.year} {t.hour:02d}:{t.minute:02d}:{t.second:02d} " \
               f"{rng.choice(['GMT', 'UTC', 'EST', 'PDT'])}", epoch
    if layout == "one_digit_day":
        return f"{wd}, {day1} {mon} {local.year} {local.hour}:{local.minute:02d}:{local.second:02d} {num}", epoch
    if layout == "rfc3339":
        frac = rng.choice(["", ".5", ".123456789"])
        return f"{local:%Y-%m-%dT%H:%M:%S}{frac}{colon}", epoch
    if layout == "zulu":
        return f"{t:%Y-%m-%dT%H:%M:%S}Z", epoch
    if layout == "rfc822z":
        return f"{local.day:02d} {mon} {local:%y} {local.hour:02d}:{local.minute:02d} {num}", epoch - t.second
    if layout == "datetime":
        return f"{t:%Y-%m-%d %H:%M:%S}", epoch
    if layout == "date":
        midnight = int(dt.datetime(t.year, t.month, t.day, tzinfo=dt.timezone.utc).timestamp())
        return f"{t:%Y-%m-%d}", midnight
    raise ValueError(layout)


LAYOUTS = ["rfc1123z", "rfc1123", "one_digit_day", "rfc3339", "zulu", "rfc822z", "datetime", "date"]


def test_random_instants_in_every_layout(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        # two-digit years pivot at 69: stay within 1969..2068 for the RFC822 shape
        t = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=rng.randint(0, 3_000_000_000))
        layout = rng.choice(LAYOUTS)
        text, epoch = render(t, layout, rng.choice([0, 60, -300, 330, -420, 765]), rng)
        rows.append((text, epoch))
    for bad in ["Mon, 30 Feb 2006 10:00:00 +0000", "2006-13-01", "2006-01-02 24:00:00", "Mon, 02 Foo 2006 10:00:00 GMT",
                "2006-01-02T15:04:05", "02 Jan 2006 15:04 +0000", ""]:
        rows.append((bad, 0))
    df = spark.createDataFrame(rows, "t string, want bigint")
    wrong = df.where(parse_feed_date(F.col("t")) != F.col("want")).collect()
    assert not wrong, wrong[:5]
