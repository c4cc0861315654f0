"""Column functions: identifiers, dates, ranges, flags and levels. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

#: Evidence levels from strong to weak (fixed values).
LEVELS = ("provisional", "review_required", "conflicting", "unavailable")


def pad_identifier(n: Column, width: int = 10) -> Column:
    """A number as zero-padded text; null stays null."""
    return F.lpad(n.cast("long").cast("string"), width, "0")


def normalise_registrant(text: Column) -> Column:
    """Ten digits from digits with an optional CIK prefix, in 1..9,999,999,999; else null."""
    digits = F.regexp_extract(F.upper(F.trim(text)), r"^(?:CIK)?0*([0-9]{1,10})$", 1)
    n = F.when(digits != "", digits.cast("long"))
    return F.when(n.between(1, 9_999_999_999), pad_identifier(n))


def parse_accession(text: Column) -> Column:
    """struct<filer, year, sequence> of an 18-digit number, dashed or plain; null when it has another form."""
    m = r"^([0-9]{10})-?([0-9]{2})-?([0-9]{6})$"
    whole = F.rlike(text, F.lit(r"^[0-9]{18}$")) | F.rlike(text, F.lit(r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$"))
    return F.when(whole, F.struct(*(F.regexp_extract(text, m, k).alias(n) for k, n in ((1, "filer"), (2, "year"), (3, "sequence")))))


def strict_date(text: Column) -> Column:
    """A date from YYYY-MM-DD that is in the calendar; compact and unpadded forms give null."""
    return F.when(F.rlike(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date(text, "yyyy-MM-dd"))


def date_part(stamp: Column) -> Column:
    """The date in the first eight digits of YYYYMMDDHHMMSS; null otherwise."""
    return F.when(F.rlike(stamp, F.lit("^[0-9]{8}")), F.try_to_date(F.substring(stamp, 1, 8), "yyyyMMdd"))


def eastern_to_utc(wall: Column, zone: str = "America/New_York") -> Column:
    """struct<utc, problem>: `gap` for a wall-clock time that doesn't exist, `overlap` for one that exists twice, else null.

    Both are refused, none is resolved: utc is null there.
    """
    utc = F.to_utc_timestamp(wall, zone)
    hour = F.expr("interval 1 hour")
    gap = F.from_utc_timestamp(utc, zone) != wall
    twice = (F.from_utc_timestamp(utc + hour, zone) == wall) | (F.from_utc_timestamp(utc - hour, zone) == wall)
    problem = F.when(gap, "gap").when(twice, "overlap")
    return F.struct(F.when(problem.isNull(), utc).alias("utc"), problem.alias("problem"))


def circular_day_distance(a: Column, b: Column) -> Column:
    """Days between two month-days on the circle of the leap year 2000."""
    on = lambda d: F.make_date(F.lit(2000), F.month(d), F.dayofmonth(d))
    d = F.abs(F.datediff(on(a), on(b)))
    return F.least(d, 366 - d)


def window_label(day: Column, windows: Sequence[tuple[str, str, str]], support: tuple[str, str, str] | None = None) -> Column:
    """The name of the inclusive window that holds a date; the support label, `out_of_scope`, or `unresolved` for null."""
    out = F.when(day.isNull(), "unresolved")
    for name, start, end in (*windows, *((support,) if support else ())):
        out = out.when(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), name)
    return out.otherwise("out_of_scope")


def mapped(label: Column) -> Column:
    """Whether a label is neither null nor out of scope (so a support label is mapped)."""
    return label.isNotNull() & (label != "out_of_scope")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)


def weakest(levels: Iterable[Column]) -> Column:
    """The weakest of several levels."""
    return level_name(F.greatest(*(level_rank(x) for x in levels), F.lit(0)))


def seeded_rank(seed: str, *keys: Column) -> Column:
    """SHA-256 of seed and keys joined by a bar, as hexadecimal text: a reproducible random order."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)), 256)


def reasons(**tests: Column) -> Column:
    """The names of the tests that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def only_one(**tests: Column) -> Column:
    """The name of the one test that holds; null when none or several do."""
    found = reasons(**tests)
    return F.when(F.size(found) == 1, found[0])


def missing_fields(*names: str) -> Column:
    """Names of the columns that are null or empty."""
    return F.array_compact(F.array(*(F.when(F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == ""), F.lit(n)) for n in names)))


def status_token(text: Column) -> Column:
    """White space collapsed, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, empty and '.' segments collapsed, query sorted.

    A URL with a '..' segment, a user or another scheme than http(s) gives null.
    """
    scheme, rest = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.regexp_extract(url, r"^[A-Za-z]+://([^#]*)", 1)
    authority = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), r"/(?:\.?/)+", "/")
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"/\.$", "/"))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    bad = ~scheme.isin("http", "https") | (authority == "") | F.contains(authority, F.lit("@")) | F.rlike(path, F.lit(r"(?:^|/)\.\.(?:/|$)"))
    return F.when(~bad, F.concat(scheme, F.lit("://"), authority, path, F.when(query != "", F.concat(F.lit("?"), ordered)).otherwise("")))


def response_class(status: Column) -> Column:
    """What to do after an HTTP response."""
    return F.when(status.between(200, 299), "accept").when(status == 304, "reuse").when(status == 429, "cool_down").when(status.isin(408, 500, 502, 503, 504), "retry").when(status == 403, "block").otherwise("fail")
