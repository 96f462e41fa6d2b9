"""Text, number and date expressions with the same rules on every path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprep.functions.columns import PrepError, col, family_of
from tableprep.functions.dates import infer_date_formats, likely, parsed

# Unicode white space, as characters for trimming and as a pattern for splitting.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# Texts a number parser accepts once the ASCII white space around them is gone.
NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))$"
INTEGER = r"^[+-]?\d+$"
ASCII_SPACE = "\t\n\x0b\x0c\r "
NUMBER_STARTS = list("0123456789+-.iI")

# Date shapes (pattern of the text, Spark format); month-first before day-first.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d H:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}$", "yyyy-M-d'T'H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d'T'H:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} ?(?i:[AP]M)$", "M/d/yyyy h:mm[ ]a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} ?(?i:[AP]M)$", "M/d/yyyy h:mm:ss[ ]a"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2} ?(?:Z|[+-]\d{2}:?\d{2})$", "yyyy-M-d[ ]['T']H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2} ?(?:Z|[+-]\d{2}:?\d{2})$", "yyyy-M-d[ ]['T']H:mm:ss"),
    (
        r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}\.\d{1,6} ?(?:Z|[+-]\d{2}:?\d{2})$",
        "yyyy-M-d[ ]['T']H:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    ),
]
# Times with a zone keep the clock time that they show; the zone is cut off before parsing.
ZONE = r"(?<=:\d{2}|\.\d{1,6}) ?(?:Z|[+-]\d{2}:?\d{2})$"
# The same dates in fewer shapes, for columns whose first value fixes no format.
ANY_DATE_SHAPES = [
    (
        r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?$",
        "yyyy-M-d[[ ]['T']H:mm[:ss][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]]",
    ),
    (r"^\d{4}/\d{1,2}/\d{1,2}(?: \d{1,2}:\d{2}:\d{2})?$", "yyyy/M/d[ H:mm:ss]"),
    (r"^\d{1,2}/\d{1,2}/\d{4}(?: \d{1,2}:\d{2}(?::\d{2})?)?$", "M/d/yyyy[ H:mm[:ss]]"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2},? \d{4}$", "[MMMM][MMM] d[,] yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(?::\d{2})? ?(?i:[AP]M)$", "M/d/yyyy h:mm[:ss][ ]a"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}[ -][A-Za-z]{3,9}[ -]\d{4}$", "d[ ][-][MMMM][MMM][ ][-]yyyy"),
]
DATE_START = r"^(?:\d{1,4}[-/. ]|[A-Za-z]{3,9} \d)"
# Strftime directives and their Spark letters.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS",
    "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "D", "p": "a", "z": "xx", "Z": "z",
}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_one_of(tidy: Column, words: list[str]) -> Column:
    """Membership of a stripped text in a short word list; long texts are ruled out by size."""
    longest = max(len(w.encode()) for w in words)
    return (F.octet_length(tidy) <= longest) & tidy.isin(words)


def word_count(c: Column) -> Column:
    inner = strip(c)
    return F.when(inner == "", F.lit(0)).when(inner.isNotNull(), F.size(F.split(inner, WHITESPACE_RUN)))


def to_number(c: Column, family: str) -> Column:
    """Number of a cell, or null where it has none; text is parsed strictly."""
    if family == "text":
        inner = F.btrim(c, F.lit(ASCII_SPACE))
        # The first character rules out most texts before a pattern has to read them.
        likely = F.substring(inner, 1, 1).isin(NUMBER_STARTS)
        return F.when(likely, F.when(inner.rlike(NUMBER), inner.try_cast("double")))
    if family in ("long", "double", "decimal", "bool"):
        return c.cast("double")
    return F.lit(None).cast("double")


def double_text(c: Column) -> Column:
    """Shortest decimal text of a double: 0.5, 10000000.0, 1.5e-05, 1e+16."""
    size = F.abs(c)
    plain = c.cast("string")
    mid = c.cast("string").cast("decimal(38,12)").cast("string")
    mid = F.regexp_replace(F.regexp_replace(mid, r"0+$", ""), r"\.$", ".0")
    small = F.regexp_replace(c.cast("string").cast("decimal(38,22)").cast("string"), r"0+$", "")
    mantissa = F.regexp_replace(F.split_part(plain, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(plain, F.lit("E"), F.lit(2)).cast("int")
    far = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when((size < 1e7) & ((size >= 1e-3) | (size == 0)), plain)
        .when((size >= 1e7) & (size < 1e16), mid)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(F.isnan(c), F.lit(None))
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .otherwise(far)
    )


def as_text(c: Column, family: str) -> Column:
    """Category text of a cell; the one form used by fits, lookups and drift."""
    if family == "text":
        return c
    if family == "double":
        return double_text(c.cast("double"))
    if family == "bool":
        return F.when(c, "True").when(~c, "False")
    if family == "other":
        return F.to_json(F.struct(c.alias("v")))
    return c.cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    return as_text(col(name), family_of(df.schema[name].dataType))


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(col(name), family_of(df.schema[name].dataType))


def spark_date_format(strftime: str) -> str:
    """Spark pattern for a strftime format; letters outside directives are quoted."""
    out = []
    for directive, literal in re.findall(r"%(.)|([^%]+)", strftime, re.S):
        if directive == "%":
            out.append("%")
        elif directive in STRFTIME:
            out.append(STRFTIME[directive])
        elif directive:
            raise PrepError(f"Unsupported date format directive: %{directive}")
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", literal.replace("'", "''")))
    return "".join(out)


def _parse(c: Column, shapes: list[tuple[str, str]]) -> Column:
    clock = lambda shape: F.regexp_replace(c, ZONE, "") if "Z|" in shape else c

    def time(shape: str, fmt: str) -> Column:
        found = F.try_to_timestamp(clock(shape), F.lit(fmt))
        # Fixed value: two-digit years from 69 on are of the last century.
        return F.when(F.year(found) > 2068, found - F.make_interval(years=F.lit(100))).otherwise(found) if fmt.endswith("/yy") else found

    tried = [F.when(c.rlike(shape), time(shape, fmt)) for shape, fmt in shapes]
    parsed = F.coalesce(*tried) if len(tried) > 1 else tried[0]
    return F.when(c.rlike(DATE_START), parsed).cast("timestamp_ntz")


def guess_date_shapes(spark, samples: dict[str, str | None]) -> dict[str, int | None]:
    """Index of the first date shape that parses each sample text; one job for all of them."""
    likely = [
        (name, i) for name, text in samples.items() if text is not None for i, (shape, _) in enumerate(DATE_SHAPES)
        if re.search(shape.replace("(?i:[AP]M)", "[APap][Mm]"), text)
    ]
    out: dict[str, int | None] = dict.fromkeys(samples)
    if likely:
        row = spark.range(1).select(*[_parse(F.lit(samples[name]), [DATE_SHAPES[i]]).isNotNull().alias(f"p{k}") for k, (name, i) in enumerate(likely)]).first()
        for (name, i), fits in reversed(list(zip(likely, row))):
            out[name] = i if fits else out[name]
    return out


def date_forms(df: DataFrame, samples: dict[str, list[str]], values: DataFrame | None = None) -> dict[str, int | str | None]:
    """Per text column the shape that reads its first value, else the format derived from all its values, else None.

    ``values`` are counts (column_name, value, n) of these columns, where the caller has them.
    """
    shapes: dict[str, int | str | None] = guess_date_shapes(df.sparkSession, {n: values[0] if values else None for n, values in samples.items()})
    return shapes | infer_date_formats(df, [n for n, shape in shapes.items() if shape is None and likely(samples[n])], values)


def to_time(c: Column, dtype: T.DataType, shape: int | str | None = None, fmt: str | None = None) -> Column:
    """Timestamp of a cell. Text uses the given format, else the guessed shape or derived format, else any known shape."""
    family = family_of(dtype)
    if family == "time":
        return c.cast("timestamp_ntz")
    if family != "text":
        return F.lit(None).cast("timestamp_ntz")
    if fmt is not None:
        return F.try_to_timestamp(c, F.lit(spark_date_format(fmt))).cast("timestamp_ntz")
    if isinstance(shape, str):
        return parsed(c, shape)
    return _parse(c, ANY_DATE_SHAPES if shape is None else [DATE_SHAPES[shape]])


def iso_time(c: Column) -> Column:
    """ISO text of a timestamp; fraction only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100.0)


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of a row's texts, length-prefixed so that no two rows share an encoding."""
    parts = [F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))
