"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTES = "\"'“”„«»"
BRACKETS = "\\[\\]{}()"
DELIMITERS = ",;|/，；、\\s"
PLACEHOLDERS = ("null", "none", "nan", "na", "n/a", "-", "--", "?")


def unpack(text: Column, item: str | None = None, quotes: str = QUOTES, brackets: str = BRACKETS, delimiters: str = DELIMITERS, placeholders: tuple = PLACEHOLDERS) -> Column:
    """Array of the values of a packed string, in the order written.

    The text is split on quote characters: odd pieces stand between two quotes and are literals, even pieces are split
    on the delimiters. An array fold puts the pieces back in order. Two quotes in a row within a literal stand for one
    quote, so literals with nothing between them are one. A quote that is never closed is no quote: the last piece then
    counts as unquoted. Brackets go outside of quotes only. With item (a regular expression that matches the start of a
    value) a literal that holds several values is a quoted list and is split before each value, and quotes and delimiters
    at the ends of a literal go. Null and blank texts, empty pieces and placeholders give no value; a repeated value stays
    at each place.
    """
    pieces = F.split(text, f"[{quotes}]", -1)
    n = F.size(pieces)
    loose = lambda p: F.split(F.regexp_replace(p, f"[{brackets}]", " "), f"[{delimiters}]+", -1)
    if item:
        edge = f"[{delimiters}{quotes}]+"
        literal = lambda p: F.transform(F.split(p, f"{edge}(?={item})", -1), lambda x: F.regexp_replace(x, f"^{edge}|{edge}$", ""))
    else:
        literal = lambda p: F.array(F.trim(p))
    none = F.lit(None).cast("string")

    def step(acc: Column, piece: Column) -> Column:
        p, i = piece["p"], piece["i"]
        quoted = (i % 2 == 1) & (i < n - 1)
        doubled = (i % 2 == 0) & (i < n - 1) & (p == "") & acc["open"].isNotNull()
        closed = F.when(acc["open"].isNotNull(), F.concat(acc["values"], literal(acc["open"]))).otherwise(acc["values"])
        return (
            F.when(quoted, F.struct(acc["values"].alias("values"), F.when(acc["open"].isNull(), p).otherwise(F.concat(acc["open"], F.lit('"'), p)).alias("open")))
            .when(doubled, acc)
            .otherwise(F.struct(F.concat(closed, loose(p)).alias("values"), none.alias("open")))
        )

    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    values = F.aggregate(numbered, F.struct(F.array().cast("array<string>").alias("values"), none.alias("open")), step)["values"]
    return F.coalesce(F.filter(values, lambda v: (v != "") & ~F.lower(v).isin(*placeholders)), F.array().cast("array<string>"))


def explode_packed(df: DataFrame, column: str, value: str, position: str = "list_pos", **how) -> DataFrame:
    """One row per value of column, with its 1-based position; rows without a value go. Other columns stay.

    Narrow: no shuffle, whatever the length of the lists. Raises ValueError when an output name is taken.
    """
    if {value, position} & (set(df.columns) - {column}):
        raise ValueError(f"{value} or {position} is a column already")
    rest = [df[c] for c in df.columns if c != column]
    out = df.select(*rest, F.posexplode(unpack(df[column], **how)).alias("_i", "_v"))
    return out.select(*[out[c] for c in df.columns if c != column], (F.col("_i") + 1).alias(position), F.col("_v").alias(value))
