"""File metadata: dates, and what makes them suspicious."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days that a file lay untouched, and minutes around its submission, for suspicion.
LONG_DAYS, RECENT_MINUTES = 30, 2


def pdf_date(raw: Column) -> Column:
    """`D:YYYYMMDD[HH[mm[ss]]]` as a UTC timestamp, null if it doesn't begin so. The zone is ignored;
    months, days and times beyond their range go over into the next."""
    digits = F.regexp_extract(raw, "^D:([0-9]{8,})", 1)
    padded = F.rpad(F.substring(digits, 1, F.least(F.lit(14), F.length(digits) - F.length(digits) % 2)), 14, "0")
    part = lambda at, n: F.substring(padded, at, n).cast("int")
    day = F.date_add(F.add_months(F.make_date(part(1, 4), F.lit(1), F.lit(1)), part(5, 2) - 1), part(7, 2) - 1)
    time = F.make_dt_interval(hours=part(9, 2), mins=part(11, 2), secs=part(13, 2))
    return F.when(digits != "", day.cast("timestamp") + time)


def iso_date(raw: Column) -> Column:
    return F.try_to_timestamp(raw)


def suspicion(created: Column, modified: Column, as_of: Column) -> Column:
    """Why a file's dates are suspicious: an array of `modified_before_created` and `touched_now`."""
    before = modified < created
    gap, age = F.unix_millis(modified) - F.unix_millis(created), F.abs(F.unix_millis(as_of) - F.unix_millis(modified))
    touched = (gap > LONG_DAYS * 86_400_000) & (age < RECENT_MINUTES * 60_000)
    return F.filter(F.array(F.when(before, "modified_before_created"), F.when(touched, "touched_now")), lambda x: x.isNotNull())


def xml_tag(xml: Column, tag: str) -> Column:
    """The text of the first `tag` that holds no other, as written (no entities decoded), without
    white space around; null if there is none."""
    after = F.split(xml, f"<{tag}(?=[ \\t\\n\\r/>])")
    opened = F.filter(F.slice(after, 2, F.size(after)), lambda x: F.contains(x, F.lit(f"</{tag}>")))
    inside = F.transform(opened, lambda x: F.substring_index(F.substring(x, F.instr(x, ">") + 1, F.length(x)), f"</{tag}>", 1))
    return F.trim(F.get(F.filter(inside, lambda x: ~F.contains(x, F.lit("<"))), F.lit(0)))
