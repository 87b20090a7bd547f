"""Column functions over text: normal forms, digests, occurrences, checks of identifiers."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Full case folding as Unicode has it: letters and what each becomes, where that is one
    letter, and those that become several."""
    changed = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


_LETTERS, _FOLDED, _EXPANDED = _foldings()


def _class_of(letters: str) -> str:
    """A regular expression's class of letters. Java tries the parts of a class one by one, so
    letters of one region of Unicode stand behind one test that most characters fail."""
    regions: list[list[str]] = []
    for c in sorted(letters):
        if not regions or ord(c) - ord(regions[-1][-1]) > 0x400:
            regions.append([])
        regions[-1].append(c)
    return "[" + "".join(f"[{r[0]}-{r[-1]}&&[{''.join(r)}]]" for r in regions) + "]"


_EXPANDS = _class_of("".join(_EXPANDED))


def casefolded(text: Column, source: Column | None = None) -> Column:
    """Full case folding. Most texts are ASCII, or hold no letter that becomes several; which of
    these holds is found in ``source``, if given: what the text was made of by changes to its
    white space only. So the text itself is evaluated once."""
    source = text if source is None else source
    single = F.translate(text, _LETTERS, _FOLDED)
    several = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _EXPANDED.items(), single)
    return F.when(~source.rlike(r"[^\x00-\x7f]"), F.lower(text)).when(source.rlike(_EXPANDS), several).otherwise(single)


def normalized(text: Column) -> Column:
    """For duplicate search: white space runs become one blank, ends trimmed, case folded."""
    return casefolded(F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), text)


def lowered(text: Column) -> Column:
    """For overlap audits: like ``normalized``, but lower case only."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def template_key(*parts: Column, described: Column) -> Column:
    """Digest of parts and a normalised description, joined by the unit separator; a null
    counts as empty."""
    return digest(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts], F.coalesce(normalized(described), F.lit(""))))


def word_count(text: Column) -> Column:
    """The default token counter: words between white space; 0 for null and blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0)).cast("long")


def occurrences(text: Column, value: Column) -> Column:
    """How often a value occurs without overlaps, from the left; 0 for an empty value."""
    n = F.length(value)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def literal_pattern(value: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrence_starts(text: Column, value: Column) -> Column:
    """Starts (code points, from 0) of the occurrences that ``occurrences`` counts: lengths of
    the pieces between them, summed up."""
    pieces = F.split(text, literal_pattern(value), -1)
    steps = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
    step = lambda acc, n: F.struct(
        (acc["at"] + n + F.length(value)).cast("int").alias("at"), F.concat(acc["out"], F.array((acc["at"] + n).cast("int"))).alias("out")
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.when(F.length(value) > 0, F.aggregate(steps, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<int>"))


def overlap(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Half-open intervals share a position."""
    return (a_start < b_stop) & (b_start < a_stop)


def luhn(value: Column) -> Column:
    """The digits of a value pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(value, r"[^0-9]", ""))
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    numbers = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))
    return (F.length(digits) > 0) & (F.aggregate(F.transform(numbers, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0)


def ipv4(value: Column) -> Column:
    """Four decimal groups up to 255 without leading zeros."""
    group = r"(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return value.rlike(rf"^(?:{group}\.){{3}}{group}$")


def ipv6(value: Column) -> Column:
    """Eight groups of up to four hex digits, of which one run may be left out as ``::``."""
    groups = F.filter(F.split(value, ":"), lambda g: g != "")
    fits = F.forall(groups, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}$"))
    gaps = F.regexp_count(value, F.lit("::"))
    ends = value.rlike(r"^(?:::|[0-9A-Fa-f])") & value.rlike(r"(?:::|[0-9A-Fa-f])$") & ~value.contains(":::")
    return fits & ends & (((gaps == 0) & (F.size(groups) == 8)) | ((gaps == 1) & (F.size(groups) <= 7)))


def synthetic_id(version: Column, split: Column, family: Column, variant: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("synthetic"), version, split, family, F.lpad(variant.cast("string"), 5, "0"), F.left(digest(text), F.lit(12)))


def ratio(top: Column, bottom: Column, places: int) -> Column:
    """A rounded share; 0 where there is nothing to share."""
    return F.round(F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0)), places)
