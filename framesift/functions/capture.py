"""Capture times from EXIF text, file names and file times, as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXIF = r"^\s*(\d{4})[:\-](\d{2})[:\-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
_OFFSET = r"^\s*([+-])(\d{2}):(\d{2})\s*$"


def civil_ms(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Epoch milliseconds of a date and time (UTC); null unless it is a real date from 1900 to 2999.

    Second 60 counts as the first of the next minute.
    """
    good = year.between(1900, 2999) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60)
    return F.when(good, F.unix_millis(F.try_make_timestamp(year, month, day, hour, minute, second, F.lit("UTC"))))


def _numbers(parts: list[Column]) -> list[Column]:
    return [p.try_cast("int") for p in parts]


def exif_ms(text: Column, offset: Column | None = None) -> Column:
    """An EXIF date and time, less its offset from UTC; a broken offset is ignored, a broken date gives null."""
    local = civil_ms(*_numbers([F.regexp_extract(text, _EXIF, i) for i in range(1, 7)]))
    return local if offset is None else local - F.coalesce(offset_minutes(offset), F.lit(0)) * 60_000


def offset_minutes(text: Column) -> Column:
    """+HH:MM or -HH:MM in minutes; null for other text, hours above 23 or minutes above 59."""
    sign, hours, minutes = (F.regexp_extract(text, _OFFSET, i) for i in (1, 2, 3))
    h, m = _numbers([hours, minutes])
    total = h * 60 + m
    return F.when((h <= 23) & (m <= 59), F.when(sign == "-", -total).otherwise(total))


def digit_groups(text: Column) -> Column:
    """All runs of digits."""
    return F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))


def _fixed(text: Column, widths: tuple[int, ...]) -> list[Column]:
    out, at = [], 1
    for w in widths:
        out.append(F.substring(text, at, w))
        at += w
    return out


def groups_ms(groups: Column) -> Column:
    """The time that an array of digit groups starts with: 14 digits, 8 and 6, or 4 and five times 2."""
    part = lambda i: F.coalesce(F.try_element_at(groups, F.lit(i)), F.lit(""))
    whole = civil_ms(*_numbers(_fixed(part(1), (4, 2, 2, 2, 2, 2))))
    two = civil_ms(*_numbers(_fixed(part(1), (4, 2, 2)) + _fixed(part(2), (2, 2, 2))))
    six = civil_ms(*_numbers([part(i) for i in range(1, 7)]))
    six_wide = (F.length(part(1)) == 4) & F.forall(F.slice(groups, 2, 5), lambda x: F.length(x) == 2) & (F.size(groups) >= 6)
    return F.when(F.length(part(1)) == 14, whole).when((F.length(part(1)) == 8) & (F.length(part(2)) == 6), two).when(six_wide, six)


def filename_ms(name: Column) -> Column:
    """The time in a file name without its extension: the first place in its digit groups that gives one."""

    def first_time(groups: Column) -> Column:
        starts = F.when(F.size(groups) > 0, F.sequence(F.lit(1), F.size(groups))).otherwise(F.array().cast("array<int>"))
        likely = F.filter(starts, lambda i: F.length(F.element_at(groups, i)).isin(4, 8, 14))
        times = F.transform(F.transform(likely, lambda i: F.slice(groups, i, F.lit(6))), groups_ms)
        return F.try_element_at(F.filter(times, lambda t: t.isNotNull()), F.lit(1))

    # in an array of one, so that the groups are taken once and not wherever they are named
    return F.element_at(F.transform(F.array(digit_groups(stem(name))), first_time), 1)


def stem(name: Column) -> Column:
    """A file name without its last extension; a name that starts with its only dot has none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The last extension in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(name, r".\.([^./]+)$", 1))


def resolve(original: Column, datetime: Column, name: Column, mtime_ms: Column) -> Column:
    """struct<at,source>: the EXIF original time, the EXIF time, the file name's, the file's, or unknown."""
    options = [(original, "exif_original"), (datetime, "exif_datetime"), (filename_ms(name), "filename_inferred"), (mtime_ms, "filesystem_mtime")]
    found = [F.when(at.isNotNull(), F.struct(at.cast("bigint").alias("at"), F.lit(source).alias("source"))) for at, source in options]
    return F.coalesce(*found, F.struct(F.lit(None).cast("bigint").alias("at"), F.lit("unknown").alias("source")))
