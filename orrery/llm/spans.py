"""Places of regular expressions' matches in whole texts, by SQL functions alone.

Running sums and maxima over an array are scans by doubling (log2 n passes of n elements),
and parts of a text are taken from its pieces of PIECE characters, so the work on one text
grows as n log n with its matches, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EMPTY = "array<struct<start:bigint,stop:bigint,text:string>>"
PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative `op` over an array: out[i] = values[0] op ... op values[i]."""
    rounds = F.when(F.size(values) > 1, F.ceil(F.log2(F.size(values).cast("double"))).cast("int")).otherwise(F.lit(0))
    steps = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), F.lit(1), rounds)

    def step(s: Column, by: Column) -> Column:
        back = F.concat(F.array_repeat(F.element_at(s, 1), by), F.slice(s, F.lit(1), F.size(s) - by))
        return F.zip_with(s, F.transform(back, lambda x, i: F.when(i >= by, x)), lambda x, y: F.when(y.isNull(), x).otherwise(op(y, x)))

    return F.aggregate(steps, values, step)


def matches(text: Column, pattern: str, where: Column | None = None) -> Column:
    """array<struct<start, stop, text>> of the leftmost non-overlapping matches, in code points, stop exclusive.

    The text between the matches gives their places: it is split by the same pattern that
    extracts them. `where` is a condition without which there is no match. A null
    text has no match.
    """

    def placed(found: Column) -> Column:
        both = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        span = lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("text"))
        return let(both, lambda sizes: F.zip_with(scan(sizes, lambda x, y: x + y), found, span))

    some = F.coalesce(F.rlike(text, F.lit(pattern)) if where is None else where & F.rlike(text, F.lit(pattern)), F.lit(False))
    return F.when(some, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(EMPTY))


def pieces(text: Column) -> Column:
    """The text as pieces of PIECE code points, for `part`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop (exclusive) of a text cut into pieces; '' where stop is not beyond start."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
    near = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
    return F.when(stop > start, F.substring(near, (start - first * PIECE + 1).cast("int"), (stop - start).cast("int"))).otherwise(F.lit(""))


def reached(spans: Column) -> Column:
    """For each of the spans, in order of start: where the furthest of those before it stops (0 for the first)."""
    return F.transform(F.concat(F.array(F.lit(0).cast("long")), F.slice(scan(F.transform(spans, lambda s: s["stop"]), F.greatest), F.lit(1), F.size(spans) - 1)), lambda x: x)


def apart(spans: Column, others: Column) -> Column:
    """Those of `spans` that overlap none of `others`: array<struct<start, stop, at (place in spans)>>, in order of start."""
    place = lambda s, at: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), at.alias("at"))
    every = F.array_sort(F.concat(F.transform(others, lambda s: place(s, F.lit(-1))), F.transform(spans, place)))

    def kept(all_: Column) -> Column:
        far = scan(F.transform(all_, lambda s: F.when(s["at"] < 0, s["stop"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        most = F.lit(2**62)
        near = F.reverse(scan(F.transform(F.reverse(all_), lambda s: F.when(s["at"] < 0, s["start"]).otherwise(most)), F.least))
        free = F.zip_with(F.zip_with(all_, far, lambda s, f: F.struct(s.alias("s"), f.alias("f"))), near, lambda x, n: F.struct(x["s"].alias("s"), ((x["s"]["at"] >= 0) & (x["f"] <= x["s"]["start"]) & (n >= x["s"]["stop"])).alias("ok")))
        return F.transform(F.filter(free, lambda x: x["ok"]), lambda x: x["s"])

    return F.when(F.size(spans) == 0, F.array().cast("array<struct<start:bigint,stop:bigint,at:int>>")).otherwise(let(every, kept))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def in_order(spans: Column) -> Column:
    """array<struct<start, kind, stop>> by start, then kind."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """'kind:start:stop' of array<struct<start, kind (number), stop, ...>> by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def replaced(text: Column, spans: Column, kinds: tuple[str, ...]) -> Column:
    """The text with '[KIND]' for each span; of overlapping spans the first names them all."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in kinds))

    def whole(ordered: Column, cut: Column) -> Column:
        each = F.zip_with(ordered, reached(ordered), lambda s, r: F.when(s["start"] >= r, F.concat(part(cut, r, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(F.lit("")))
        rest = part(cut, F.array_max(F.transform(ordered, lambda s: s["stop"])), F.length(text).cast("long"))
        return F.concat(F.array_join(each, ""), rest)

    return F.when(F.size(spans) > 0, let(in_order(spans), lambda ordered: let(pieces(text), lambda cut: whole(ordered, cut)))).otherwise(text)


def count_of(spans: Column, field: str, value) -> Column:
    """How many of the spans have `value` in `field`."""
    return F.size(F.filter(spans, lambda s: s[field] == F.lit(value))).cast("long")
