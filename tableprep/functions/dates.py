"""Date formats derived from a column's own values, for texts that no fixed shape reads.

A text becomes a pattern of token classes (digit runs by length, month names, day halves, separators). The patterns of all
columns are counted in one grouped job; the most frequent one gives a format, and the ranges of its numbers settle which
of two numbers is the month, the day or the year.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import col

# Longer texts are no dates; numbers of a text whose ranges are kept.
LONGEST, NUMBERS = 60, 8

# English names.
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?"
# What a text is freed of before anything else: names of week days, ordinal endings, dots after names, zones after a clock
# time, digits beyond microseconds. A time keeps the clock that it shows.
NORMAL = [
    (rf"(?i)\b{DAYS}\b[,.]? *", ""), (r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), (r"(?i)\bsept\b", "Sep"), (r"(?i)\b([a-z]{3})\. ", "$1 "),
    (r"(?i)\b([ap])\.m\.", "$1m"), (r"[\s ]+", " "), (r"(:\d{2})[.,](\d{1,6})\d*", "$1.$2"),
    (r"(?i)(:\d{2}(?:\.\d{1,6})?) ?(?:z|utc|gmt|[+-]\d{2}:?\d{2})$", "$1"), (r"^ | $", ""),
]
# Classes: full and short month names, halves of a day, fractions, and digit runs of 8, 6, 4, 3 and 1 or 2.
CLASSES = [
    (r"(?<![a-z])(?:" + "|".join(m for m in MONTHS if len(m) > 3) + r")(?![a-z])", "B"), (r"(?<![a-z])(?:" + "|".join(m[:3] for m in MONTHS) + r")(?![a-z])", "N"),
    (r"(?<![a-z])[ap]m(?![a-z])", "P"), (r"(:\d{2})\.\d{1,6}", "$1F"),
    *[(rf"(?<!\d)\d{{{size}}}(?!\d)", sign) for size, sign in (("8", "E"), ("6", "K"), ("4", "Y"), ("3", "J"), ("1,2", "D"))],
]
COUNTED = "EKYJDF"
FRACTION = "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"


def _replaced(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        text = re.sub(pattern, to.replace("$", "\\"), text)
    return text


def pattern_text(text: str) -> str:
    """The pattern of one text, by the same rules as :func:`pattern_of`."""
    return _replaced(_replaced(text, NORMAL).lower(), CLASSES)


def normal(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, F.lit(rule[0]), F.lit(rule[1])), NORMAL, c)


def pattern_of(tidy: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, F.lit(rule[0]), F.lit(rule[1])), CLASSES, F.lower(tidy))


def format_of(pattern: str, highest: list[int]) -> str | None:
    """Spark format of a pattern whose numbers reach up to ``highest``, in their order; None where it is no full date."""
    if re.search(r"[\d\[\]{}#'\"]|[a-su-z]", pattern):
        return None
    letters: dict[int, str] = {}
    top = {at: high for at, high in zip([i for i, sign in enumerate(pattern) if sign in COUNTED], highest)}
    half = "P" in pattern
    clock = re.search(r"D:D(:D)?F?", pattern) or (re.search(r"D(?= ?P)", pattern) if half else None)
    if clock:
        places = [i for i in range(*clock.span()) if pattern[i] == "D"]
        letters |= dict(zip(places, ["h" if half else "H", "mm", "ss"]))
    elif half:
        return None
    if "tK" in pattern:
        letters[pattern.index("tK") + 1] = "HHmmss"
    of = lambda sign: [i for i, s in enumerate(pattern) if s == sign and i not in letters]
    days, years, names = of("D"), of("Y"), of("B") + of("N")
    if of("K") or len(names) > 1 or len(years) > 1 or len(of("E")) + len(of("J")) > 1:
        return None
    if of("E"):
        if days or years or names:
            return None
        letters[of("E")[0]] = "yyyyMMdd"
    elif of("J"):
        if days or names or not years:
            return None
        letters[of("J")[0]] = "DDD"
    elif names and years and len(days) <= 1:
        letters |= dict.fromkeys(days, "d")
    elif names and not years and len(days) == 2:
        letters |= dict(zip(days, ("yy", "d") if top[days[0]] > 31 else ("d", "yy")))
    elif years and not names and len(days) == 1:
        letters[days[0]] = "M"
    elif not names and len(days) == 2 + (not years):
        dotted = "." in pattern[days[0] : days[1]]
        if years and years[0] < days[0]:
            swapped = top[days[0]] > 12 >= top[days[1]]
            letters |= dict(zip(days, ("d", "M") if swapped else ("M", "d")))
        elif years and years[0] < days[1]:
            return None
        elif not years and top[days[0]] > 31:
            letters |= dict(zip(days, ("yy", "M", "d")))
        else:
            day_first = top[days[0]] > 12 or dotted and top[days[1]] <= 12
            letters |= dict(zip(days, ("d", "M", "yy") if day_first else ("M", "d", "yy")))
    else:
        return None
    signs = {"Y": "yyyy", "B": "MMMM", "N": "MMM", "P": "a", "F": FRACTION, "t": "'T'"}
    return "".join(letters.get(i, signs.get(sign, sign)) for i, sign in enumerate(pattern))


def guard_of(fmt: str) -> str:
    """Pattern of the texts that the format may read: others never reach the parser."""
    sizes = {"yyyyMMdd": r"\d{8}", "HHmmss": r"\d{6}", "yyyy": r"\d{4}", "DDD": r"\d{3}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "yy": r"\d{2}", "a": "[AaPp][Mm]", "'T'": "[Tt]"}

    def guard(part: str) -> str:
        out, at = "", 0
        for m in re.finditer(r"yyyyMMdd|HHmmss|yyyy|DDD|MMMM|MMM|yy|'T'|mm|ss|[MdHh]|a", part):
            out += re.escape(part[at : m.start()]) + sizes.get(m[0], r"\d{1,2}")
            at = m.end()
        return out + re.escape(part[at:])

    return "^" + r"\.\d{1,6}".join(map(guard, fmt.split(FRACTION))) + "$"


def parsed(c: Column, fmt: str) -> Column:
    """Timestamp of a text under a derived format, else null. Two-digit years from 69 on are of the last century."""
    guard = guard_of(fmt)
    # Most texts fit as they are.
    tidy = F.when(c.rlike(guard), c).otherwise(normal(F.when(F.char_length(c) <= LONGEST, c)))
    found = F.try_to_timestamp(F.when(tidy.rlike(guard), tidy), F.lit(fmt))
    if re.search(r"(?<!y)yy(?!y)", fmt):
        found = F.transform(F.array(found), lambda t: F.when(F.year(t) > 2068, t - F.make_interval(years=F.lit(100))).otherwise(t))[0]
    return found.cast("timestamp_ntz")


def likely(texts: list[str]) -> bool:
    """Whether one of a column's first texts could have a format at all; spares other columns the job."""
    return any(len(t) <= LONGEST and format_of(pattern_text(t), [1] * NUMBERS) is not None for t in texts)


def infer_date_formats(df: DataFrame, columns: list[str], values: DataFrame | None = None) -> dict[str, str]:
    """Format of the most frequent pattern of each text column that has one: one grouped job for all columns.

    ``values`` are counts (column_name, value, n) of the columns, where the caller has them: each value is then read once.

    Texts are counted by their form with every digit as 9, pre-aggregated in each task; only these forms are turned into
    patterns. Of equal counts the smaller pattern counts. Columns without a date pattern are left out.
    """
    if not columns:
        return {}
    if values is None:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(n).alias("v")) for i, n in enumerate(columns)]))
        cells = df.select(cells.alias("c")).select("c.i", "c.v", F.lit(1).alias("n"))
    else:
        places = F.create_map(*[x for i, n in enumerate(columns) for x in (F.lit(n), F.lit(i))])
        cells = values.filter(F.col("column_name").isin(columns)).select(places[F.col("column_name")].alias("i"), F.col("value").alias("v"), "n")
    texts = cells.filter(F.char_length("v") <= LONGEST).select(
        "i", F.translate("v", "012345678", "9" * 9).alias("form"), F.regexp_extract_all("v", F.lit(r"(\d+)"), 1).alias("numbers"), "n"
    )
    forms = texts.groupBy("i", "form").agg(
        F.sum("n").alias("n"), *[F.max(F.get("numbers", F.lit(k)).try_cast("int")).alias(f"h{k}") for k in range(NUMBERS)]
    )
    counted = forms.withColumn("pattern", pattern_of(normal(F.col("form")))).groupBy("i", "pattern").agg(
        F.sum("n").alias("n"), *[F.max(f"h{k}").alias(f"h{k}") for k in range(NUMBERS)]
    )
    best = counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "pattern", *[f"h{k}" for k in range(NUMBERS)])).alias("b"))
    out = {}
    for r in best.collect():
        fmt = format_of(r["b"]["pattern"], [r["b"][f"h{k}"] or 0 for k in range(NUMBERS)])
        if fmt:
            out[columns[r["i"]]] = fmt
    return out
