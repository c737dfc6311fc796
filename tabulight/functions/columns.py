"""Typed views of a column: number, timestamp, text, and the four notions of "missing".

The building blocks are SQL text, because a profile needs hundreds of expressions and one
parsed text is far cheaper to build than a tree of calls. ``number``, ``value`` and so on
wrap them as columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulight.functions import vocab

# whitespace as text tools understand it (SQL trim() only removes the plain space)
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
DATE_TEXT_LENGTHS = (8, 40)     # from 1/1/2020 to nanoseconds and a zone


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.FloatType, T.DoubleType))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.StringType, T.CharType, T.VarcharType))


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_boolean(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.BooleanType)


def names_where(df: DataFrame, test) -> list[str]:
    return [c for c in df.columns if test(df, c)]


# --- SQL text ---------------------------------------------------------------------

def name_sql(name: str) -> str:
    """Reference to a top-level column whatever characters its name has."""
    return "`" + name.replace("`", "``") + "`"


def text_sql(text: str) -> str:
    """String literal; a dollar sign is escaped, since Spark would put a setting for ${name} before it parses."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def texts_sql(texts) -> str:
    return ", ".join(text_sql(t) for t in texts)


def double_sql(x: float | None) -> str:
    """Exact double literal (a bare 0.1 would be a decimal)."""
    return "double(null)" if x is None else f"double('{float(x)!r}')"


def strip_sql(e: str) -> str:
    return f"btrim({e}, '{''.join(f'\\u{ord(ch):04x}' for ch in WHITESPACE)}')"


def text_number_sql(e: str) -> str:
    """Double when the text is a plain number, else NULL ("1d" and "1,000" are not numbers)."""
    stripped = strip_sql(e)
    return f"case when {stripped} rlike r'{NUMBER_SHAPE}' then try_cast({stripped} as double) end"


def number_sql(df: DataFrame, name: str) -> str:
    """The column as double; NaN and unparseable values become NULL."""
    if is_floating(df, name):
        return f"nanvl(double({name_sql(name)}), null)"
    if is_numeric(df, name) or is_boolean(df, name):
        return f"cast({name_sql(name)} as double)"
    return text_number_sql(name_sql(name)) if is_text(df, name) else "double(null)"


def text_timestamp_sql(e: str, formats=tuple(vocab.DATE_FORMATS)) -> str:
    """First of the known formats that fits.

    Every format has a year of four digits; that and the shape tests keep the parser off prose.
    """
    low, high = DATE_TEXT_LENGTHS

    def parsed(fmt: str) -> str:
        if fmt != "ISO":
            return f"try_to_timestamp({e}, '{fmt}')"
        # a time with a zone is shown as the session's time, one without stays as it is
        return f"case when {e} rlike r'(Z|[+-]\\d{{2}}:?\\d{{2}})$' then try_cast(regexp_replace({e}, r' ?([+-]\\d{{2}}):?(\\d{{2}})$', '$1:$2') as timestamp) else try_cast({e} as timestamp_ntz) end"

    tries = ", ".join(f"case when {e} rlike r'{shape}' then cast({parsed(fmt)} as timestamp_ntz) end" for fmt, shape in formats)
    return (f"cast(case when length({e}) between {low} and {high} and {e} rlike r'\\d{{4}}' "
            f"then coalesce({tries}, null) end as timestamp_ntz)")


def timestamp_sql(df: DataFrame, name: str) -> str:
    """Any known format value by value: whether text is a date at all. ``plans.dates`` reads a column in one format."""
    if is_datetime(df, name):
        return f"cast({name_sql(name)} as timestamp_ntz)"
    return text_timestamp_sql(name_sql(name)) if is_text(df, name) else "cast(null as timestamp_ntz)"


def value_sql(df: DataFrame, name: str) -> str:
    """The column itself with NaN turned into NULL."""
    c = name_sql(name)
    return f"nanvl({c}, null)" if is_floating(df, name) else c


def missing_sql(df: DataFrame, name: str, level: str = "M0", none_word: bool = False) -> str:
    """Missing-value test.

    M0 NULL/NaN; M1 also blank text; M2 also 'nan' and 'undefined' (and 'None' with
    ``none_word``); M3 blank or one of the vocabulary words, ignoring case and whitespace.
    """
    if level not in ("M0", "M1", "M2", "M3"):
        raise ValueError(f"unknown missing level {level!r}")
    c = name_sql(name)
    null = f"({c} is null or isnan({c}))" if is_floating(df, name) else f"({c} is null)"
    if level == "M0" or not is_text(df, name):
        return null
    if level == "M1":
        return f"({null} or trim({c}) = '')"
    if level == "M2":
        words = ["nan", "undefined"] + (["None"] if none_word else [])
        return f"({null} or trim({c}) = '' or {c} in ({texts_sql(words)}))"
    return f"({null} or lower({strip_sql(c)}) in ({texts_sql(vocab.MISSING_WORDS)}))"


# --- columns ----------------------------------------------------------------------

def col(name: str) -> Column:
    return F.col(name_sql(name))


def number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def value(df: DataFrame, name: str) -> Column:
    return F.expr(value_sql(df, name))


def is_missing(df: DataFrame, name: str, level: str = "M0", none_word: bool = False) -> Column:
    return F.expr(missing_sql(df, name, level, none_word))


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def count_if(condition: Column) -> Column:
    """Number of rows where the condition holds; 0 on an empty table."""
    return F.count(F.when(condition, 1))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 when the whole is 0."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits), F.lit(0.0))


def severity(pct: Column, high: float, medium: float) -> Column:
    return F.when(pct > high, "HIGH").when(pct > medium, "MEDIUM").otherwise("LOW")
