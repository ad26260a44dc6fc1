"""Places of regular-expression matches as Column expressions, without Python on the executors.

``split`` and ``regexp_extract_all`` walk a text with the same matcher, so the pieces between
the matches and the matches together give every match's place in code points. Patterns are
written so that a match is found in linear time: runs are possessive and begin where no
earlier start could reach (or where the last match ended)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: int, order: int, end: int, kind: string, value: string>"
CHUNK = 128
PAGE = 1024  # code points


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _scan(values: Column, step) -> Column:
    """``step(result so far, value)`` at every place of an integer array; the first result is null."""
    return F.aggregate(
        values, F.array().cast("array<int>"),
        lambda done, n: F.concat(done, F.array(step(F.try_element_at(done, F.lit(-1)), n))),
    )


def once(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, step) -> Column:
    """Running results of an associative ``step``, the value itself included; long arrays go
    in chunks, so that the work stays nearly linear."""
    def of_chunks(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(n), F.lit(CHUNK))
        chunks = F.transform(starts, lambda at: _scan(F.slice(n, at, F.lit(CHUNK)), step))
        return once(chunks, lambda c: once(
            F.concat(F.array(F.lit(None).cast("int")), _scan(F.transform(c, lambda x: F.element_at(x, -1)), step)),
            lambda before: F.flatten(F.transform(c, lambda x, i: once(
                F.get(before, i), lambda done: F.transform(x, lambda y: step(done, y))))),
        ))

    return once(values, lambda n: F.when(F.size(n) <= CHUNK, _scan(n, step)).otherwise(of_chunks(n)))


def running_sums(lengths: Column) -> Column:
    return running(lengths, lambda done, n: F.coalesce(done, F.lit(0)) + n)


def pages_of(text: Column) -> Column:
    """The text in pieces of PAGE code points: a place is found without walking the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def piece(pages: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, taken from its pages."""
    first = F.floor(start / PAGE).cast("int")
    numbers = F.sequence(first, F.floor((end - 1) / PAGE).cast("int"))
    whole = F.array_join(F.transform(numbers, lambda i: F.coalesce(F.get(pages, i), F.lit(""))), "")
    return F.when(end > start, F.substring(whole, start - first * PAGE + 1, end - start)).otherwise(F.lit(""))


def matches(text: Column, pattern: str, kind: str, order: int, keep=None, when: Column | None = None, group: int | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches for which ``keep(value, group value)``
    holds. ``when`` is a cheap condition without which no match can exist; a null text has
    no spans."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")

    def placed(found: Column) -> Column:
        values = found["hits"]
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        ends = running_sums(F.zip_with(gaps, values, lambda gap, value: F.length(gap) + F.length(value)))
        return F.transform(F.arrays_zip(values.alias("value"), ends.alias("end"), found["parts"].alias("part")), lambda h: F.struct(
            (h["end"] - F.length(h["value"])).cast("int").alias("start"), F.lit(order).alias("order"),
            h["end"].cast("int").alias("end"), F.lit(kind).alias("kind"), h["value"].alias("value"), h["part"].alias("part"),
        ))

    every = once(F.struct(hits.alias("hits"), parts.alias("parts")), placed)
    kept = every if keep is None else F.filter(every, lambda s: F.coalesce(keep(s["value"], s["part"]), F.lit(False)))
    plain = F.transform(kept, lambda s: F.struct(*[s[k].alias(k) for k in ("start", "order", "end", "kind", "value")]))
    there = F.regexp_like(text, F.lit(pattern)) if when is None else when
    return F.when(F.coalesce(there, F.lit(False)), plain).otherwise(no_spans()).cast(f"array<{SPAN}>")


def ordered(*spans: Column) -> Column:
    return F.array_sort(F.concat(*spans))


def written(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (ordered by start) replaced by its kind in brackets; spans
    that overlap an earlier one are taken into its gap."""
    def cut(pages: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        return once(F.concat(F.array(F.lit(0)), running(ends, F.greatest)), lambda at: F.concat(
            F.array_join(F.transform(
                F.filter(F.transform(spans, lambda s, i: F.struct(
                    F.get(at, i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda s: s["start"] >= s["at"]),
                lambda s: F.concat(piece(pages, s["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))), ""),
            piece(pages, F.element_at(at, -1), F.length(text)),
        ))

    return F.when(F.size(spans) > 0, once(pages_of(text), cut)).otherwise(text)
