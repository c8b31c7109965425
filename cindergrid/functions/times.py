"""Instants, dates and ages as column expressions. All instants are UTC; what can't be read is null, never an error."""

from pyspark.sql import functions as F


def padded(c, width):
    """A whole number as text with leading zeros; null if it isn't one or is too long."""
    text = c.try_cast("bigint").cast("string")
    return F.when(F.length(text) <= width, F.lpad(text, width, "0"))


def instant(date, hhmm):
    """Instant from a date (yyyy-MM-dd) and a clock time as a number without leading zeros: 5 is 00:05, 905 is 09:05."""
    return F.try_to_timestamp(F.concat(date.cast("string"), padded(hhmm, 4)), F.lit("yyyy-MM-ddHHmm"))


def from_millis(c):
    return F.timestamp_millis(c.cast("bigint"))


def day(c):
    """Calendar day of a text or instant."""
    return c.try_cast("date")


def hours_between(start, end):
    return F.timestamp_diff("MICROSECOND", start, end) / 3.6e9


def days_between(start, end):
    return hours_between(start, end) / 24


def iso_z(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso_z(text):
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def age_minutes(text, now):
    """Whole minutes from an ISO text to now; null if the text can't be read."""
    return F.floor(F.timestamp_diff("SECOND", from_iso_z(text), now) / 60)


def freshness(age, stale_after=75):
    """unknown, stale or fresh."""
    return F.when(age.isNull(), "unknown").when(age > stale_after, "stale").otherwise("fresh")


def season(c):
    """Sine and cosine of the day of the year, over 365.25 days."""
    turn = 2 * F.pi() * F.dayofyear(c) / 365.25
    return F.sin(turn), F.cos(turn)


def hours(start, end):
    """The hours from start up to, not including, end."""
    return F.filter(F.sequence(start, end, F.expr("interval 1 hour")), lambda t: t < end)
