"""Dates and times in text: which formats a value has, as bits, and its time in one of them.

A column's times are in a format that all its values have, so that 03/04 is not read two ways in one column. Formats
differ in the order of their parts and in their separators; the time of day may be there or not, with or without seconds and
fractions. A zone is read over, as a column of times without zone does: the time stays as it is written.

Expressions are SQL text here: they are used for each column of wide frames, where a call for each node would take seconds.
"""

from __future__ import annotations

#: Bits of the formats, in the order in which they are taken where a column has several: separator and order, or the place of a month's name.
FORMATS = {("-", "ymd"): 1, ("/", "ymd"): 2, ("/", "mdy"): 4, ("/", "dmy"): 8, ("-", "mdy"): 16, ("-", "dmy"): 32, (".", "mdy"): 64, (".", "dmy"): 128, ("", "name first"): 256, ("", "day first"): 512}
_MONTH = "(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DATE = rf"(?:(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}})|(\d{{1,2}})([-/.])(\d{{1,2}})\6(\d{{4}})|({_MONTH})\.? (\d{{1,2}}),? (\d{{4}})|(\d{{1,2}})[ -]({_MONTH})[ -](\d{{4}}))"
_TIME = r"(?:[T ]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)(?: ?([AaPp][Mm]))?)?(?: ?(?:Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?))?"
#: What a value that has the pattern becomes: nothing, then its parts, split at bars.
_PARTS = "|$1|$8$11$14|$2$6|$3$5$10$12|$4$7|$9$13|$9|$15|$16"
LONGEST = 64


def date_parts(text: str) -> str:
    """SQL for the parts of a value that may be a time; null for others. One match of one pattern."""
    taken = f"CASE WHEN char_length({text}) BETWEEN 6 AND {LONGEST} AND rlike({text}, r'^[0-9A-Za-z]') THEN regexp_replace({text}, r'^{_DATE}{_TIME}$', '{_PARTS}') END"
    return f"get(filter(array(split({taken}, '[|]')), x -> size(x) = 10 AND x[0] = ''), 0)"


def may_be_date(text: str) -> str:
    """SQL that is true for all values that have a format, and for few others."""
    return f"char_length({text}) BETWEEN 6 AND {LONGEST} AND rlike({text}, r'^(?:[0-9]+[-/.][0-9]+[-/.][0-9]|[0-9]+[ -][A-Za-z]{{3}}|[A-Za-z]{{3,9}}[.]? [0-9])')"


def _date(p: str, order: str) -> str:
    """SQL for the date in that order of parts, as text."""
    month = f"(instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({p}[6], 3))) + 2) div 3"
    return {
        "ymd": f"concat({p}[1], '-', {p}[4], '-', {p}[5])",
        "mdy": f"concat({p}[2], '-', {p}[4], '-', {p}[5])",
        "dmy": f"concat({p}[2], '-', {p}[5], '-', {p}[4])",
    }.get(order, f"concat({p}[2], '-', {month}, '-', {p}[4])")


def _when(p: str, separator: str, order: str) -> str:
    """SQL for: the parts have that separator, and an order of that kind."""
    if order == "ymd":
        return f"{p}[1] <> '' AND {p}[3] = '{separator}'"
    if separator:
        return f"{p}[1] = '' AND {p}[3] = '{separator}'"
    return f"{p}[6] <> '' AND {p}[7] {'<>' if order == 'name first' else '='} ''"


def _time(p: str) -> str:
    """SQL for the time of day as text, midnight if there is none; null if its hour is not one of twelve."""
    hour, half = f"CAST(substring_index({p}[8], ':', 1) AS INT)", f"lower({p}[9])"
    later = f"concat(({hour} % 12 + CASE WHEN {half} = 'pm' THEN 12 ELSE 0 END), substring({p}[8], instr({p}[8], ':')))"
    short = f"CASE WHEN rlike({p}[8], r'^[0-9]+:[0-9]+$') THEN ':00' ELSE '' END"
    return f"CASE WHEN {p}[8] = '' THEN '0:00:00' WHEN {half} = '' THEN concat({p}[8], {short}) WHEN {hour} BETWEEN 1 AND 12 THEN concat({later}, {short}) END"


def time_formats(p: str) -> str:
    """SQL for the bits of the formats in which the parts are a time; 0 for null."""
    bits = " + ".join(f"CASE WHEN {_when(p, *fmt)} AND try_cast({_date(p, fmt[1])} AS DATE) IS NOT NULL THEN {bit} ELSE 0 END" for fmt, bit in FORMATS.items())
    return f"CASE WHEN {p} IS NULL OR try_cast(concat('2000-01-01 ', {_time(p)}) AS TIMESTAMP_NTZ) IS NULL THEN 0 ELSE {bits} END"


def parsed_time(text: str, formats: int) -> str:
    """SQL for a time without zone, in the first of the formats given as bits; null where the text has not that format."""
    for (separator, order), bit in FORMATS.items():
        if formats & bit:
            made = f"CASE WHEN {_when('p', separator, order)} THEN try_cast(concat({_date('p', order)}, ' ', {_time('p')}) AS TIMESTAMP_NTZ) END"
            return f"transform(array({date_parts(text)}), p -> {made})[0]"
    return "CAST(NULL AS TIMESTAMP_NTZ)"
