"""Positions of regular-expression matches as native array expressions.

Spark's functions return matches without positions. Here every match is wrapped in marks by ``regexp_replace``, the text
is split at the marks and the pieces' lengths are summed. The marks are control characters that no pattern of this
package touches; such characters of the text itself are first replaced one for one, so positions (code points) hold.

Everything is near linear in the text and its matches: running sums and maxima go by doubling strides instead of a fold
that copies what it has, and text is taken by position from an array of short chunks instead of from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

OPEN, CLOSE, INNER, STAND_IN = "\x01", "\x02", "\x04", "\x03"
#: Code points of a chunk that text is taken from by position.
CHUNK = 256
SPANS = "array<struct<s:int,e:int,k:int,b:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def unmarked(text: Column) -> Column:
    """The text without this module's marks, of the same length."""
    return F.translate(text, OPEN + CLOSE + INNER, STAND_IN * 3)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running results of an associative ``op`` over an array; ``op(x, null)`` must be x.

    Each of the log2(n) rounds joins every result with the one a stride before it, and the stride doubles.
    """
    strides = F.array(*[F.lit(1 << k) for k in range(31)])

    def go(all_values: Column) -> Column:
        return F.aggregate(F.filter(strides, lambda d: d < F.size(all_values)), all_values, lambda acc, d: F.transform(acc, lambda x, i: op(x, F.get(acc, i - d))))

    return let(values, go)


def running_sum(values: Column) -> Column:
    return running(values, lambda x, y: x + F.coalesce(y, F.lit(0)))


def running_max(values: Column) -> Column:
    """Of numbers that are not null."""
    return running(values, lambda x, y: F.greatest(x, y))


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, for ``taken``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def taken(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in ``chunks``; looks at the chunks in question only."""
    first = F.floor(start / CHUNK).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, F.greatest(F.floor((end - 1) / CHUNK).cast("int") - first + 1, F.lit(0))), "")
    return F.substring(joined, start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))


def matches(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column] | None = None, inner: bool = False, body: bool = False) -> Column:
    """Spans (s, e, k, b) of the leftmost non-overlapping matches in an ``unmarked`` text, in order.

    ``keep(match, rest)`` drops a match after it has been consumed; ``rest`` is its second group if ``inner`` (the pattern
    then has two groups that make up the whole match), else the match again. ``b`` holds the match if ``body``.
    """
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$1{INNER}$2{CLOSE}" if inner else f"{OPEN}$0{CLOSE}"))
    marks = 2 if inner else 1

    def piece(p: Column) -> Column:
        """Of a match and the text behind it: their length, the match's, whether it is kept."""

        def at(close: Column) -> Column:
            match = F.substring(p, F.lit(1), close - 1)
            if inner:
                whole, rest = F.translate(match, INNER, ""), F.substring(match, F.instr(match, INNER) + 1, F.length(match))
            else:
                whole = rest = match
            held = F.lit(True) if keep is None else F.coalesce(keep(whole, rest), F.lit(False))
            return F.struct((F.length(p) - marks).alias("all"), (close - marks).alias("n"), held.alias("held"), (whole if body else F.lit("")).alias("b"))

        return let(F.instr(p, CLOSE), at)

    def spans(segments: Column) -> Column:
        def placed(pieces: Column) -> Column:
            def with_ends(ends: Column) -> Column:
                start = lambda x, i: F.length(segments[0]) + F.get(ends, i) - x["all"]
                every = F.transform(pieces, lambda x, i: F.when(x["held"], F.struct(start(x, i).alias("s"), (start(x, i) + x["n"]).alias("e"), F.lit(kind).alias("k"), x["b"].alias("b"))))
                return F.array_compact(every).cast(SPANS)

            return let(running_sum(F.transform(pieces, lambda x: x["all"])), with_ends)

        return let(F.transform(F.slice(segments, 2, F.size(segments)), piece), placed)

    return let(marked, lambda m: F.when(F.instr(m, OPEN) == 0, no_spans()).otherwise(let(F.split(m, OPEN), spans)))


def in_order(spans: Column) -> Column:
    """By start, then kind."""
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["b"].alias("b")))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["b"].alias("b")))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(listed(spans, kinds).cast("binary"), 256)


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def redacted(text: Column, spans: Column, names: tuple[str, ...]) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first takes all."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in names])

    def cut_out(b: Column) -> Column:
        found, pieces, ends = b["found"], b["pieces"], b["ends"]
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        parts = F.transform(found, lambda x, i: F.when(x["s"] >= before(i), F.concat(taken(pieces, before(i), x["s"]), F.element_at(tags, x["k"] + 1))))
        return F.concat(F.array_join(F.array_compact(parts), ""), taken(pieces, F.element_at(ends, -1), F.length(text)))

    def of(found: Column) -> Column:
        ready = F.struct(found.alias("found"), chunks(text).alias("pieces"), running_max(F.transform(found, lambda x: x["e"])).alias("ends"))
        return F.when(F.size(found) == 0, text).otherwise(let(ready, cut_out))

    return let(spans, of)


def touches(spans: Column, others: Column) -> Column:
    """For each of ``spans`` (s, e, ...; by start) whether one of ``others`` (likewise) overlaps it, as an array of booleans.

    Both are merged by start. A span is overlapped if some other that starts no later ends behind its start, or the first
    other that starts behind it does so before its end: running maxima from the left and minima from the right.
    """
    far = 1 << 30
    mark = lambda a, own: F.transform(a, lambda x, i: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), i.alias("i")))

    def merged(both: Column) -> Column:
        left = running_max(F.transform(both, lambda x: F.when(x["own"] == 0, x["e"]).otherwise(F.lit(-far))))
        right = F.reverse(running_max(F.reverse(F.transform(both, lambda x: F.when(x["own"] == 0, -x["s"]).otherwise(F.lit(-far))))))
        hit = lambda b: F.transform(both, lambda x, j: F.when(x["own"] == 1, F.struct(x["i"].alias("i"), ((F.get(b["left"], j) > x["s"]) | (-F.get(b["right"], j) < x["e"])).alias("hit"))))
        return let(F.struct(left.alias("left"), right.alias("right")), lambda b: F.transform(F.array_sort(F.array_compact(hit(b))), lambda x: x["hit"]))

    return F.when(F.size(others) == 0, F.transform(spans, lambda x: F.lit(False))).otherwise(let(F.array_sort(F.concat(mark(others, 0), mark(spans, 1))), merged))
