"""Date formats of text columns: which of a list of formats parses a column, found in one aggregation.

Every row holds one bit per format that parses it. ``bit_and`` over a column leaves the formats that parse all of it; counts per
bit decide between formats where none does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepspark.functions.columns import col, one_row

# Name, shape of the date, pattern of the date. The order is the order of preference.
FORMATS: list[tuple[str, str, str]] = [
    ("iso", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", ""),
    ("ymd_slash", r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "yyyy/M/d"),
    ("ymd_dot", r"[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}", "yyyy.M.d"),
    ("compact", r"[0-9]{8}", "yyyyMMdd"),
    ("mdy_slash", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    ("dmy_slash", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy"),
    ("mdy_dash", r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "M-d-yyyy"),
    ("dmy_dash", r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "d-M-yyyy"),
    ("dmy_dot", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "d.M.yyyy"),
    ("mdy_dot", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "M.d.yyyy"),
    ("mdy_slash_short", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "M/d/yy"),
    ("dmy_slash_short", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "d/M/yy"),
    ("month_day", r"[A-Za-z]{3} [0-9]{1,2},? [0-9]{4}", "MMM d[,] yyyy"),
    ("full_month_day", r"[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}", "MMMM d[,] yyyy"),
    ("day_month", r"[0-9]{1,2}[ -][A-Za-z]{3}[ -][0-9]{4}", "d[ ][-]MMM[ ][-]yyyy"),
    ("day_full_month", r"[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}", "d MMMM yyyy"),
]
#: Formats that read the same cells as different days: a column keeps one of each.
RIVALS = [("mdy_slash", "dmy_slash"), ("mdy_dash", "dmy_dash"), ("dmy_dot", "mdy_dot"), ("mdy_slash_short", "dmy_slash_short")]
#: Two-digit years up to this one are of this century, the others of the last.
PIVOT = 68
_TIME = r"( [0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?( [AaPp][Mm])?)?"
_NAMES = [name for name, _, _ in FORMATS]


def _clean(name: str) -> str:
    """SQL of a cell without outer blanks and weekday; null where nothing is left."""
    cell = f"trim(BOTH ' \\t\\n\\r' FROM {name})"
    cell = f"regexp_replace({cell}, '^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +', '')"
    return f"nullif(regexp_replace({cell}, '([0-9]) ?([AaPp][Mm])$', '$1 $2'), '')"


def _parsed(k: int, cell: str) -> str:
    """SQL of a cleaned cell read by format k; null where it does not fit."""
    name, shape, pattern = FORMATS[k]
    if name == "iso":
        return f"CASE WHEN {cell} RLIKE r'^{shape}([ T].*)?$' THEN try_to_timestamp({cell}) END"
    whole = f"CASE WHEN {cell} RLIKE r'[AaPp][Mm]$' THEN try_to_timestamp({cell}, '{pattern} h:mm[:ss[.SSSSSS]] a') ELSE try_to_timestamp({cell}, '{pattern}[ H:mm[:ss[.SSSSSS]]]') END"
    if pattern.endswith("/yy"):
        whole = f"transform(array({whole}), t -> CASE WHEN year(t) > {2000 + PIVOT} THEN t - INTERVAL '100' YEAR ELSE t END)[0]"
    return f"CASE WHEN {cell} RLIKE r'^{shape}{_TIME}$' THEN {whole} END"


@dataclass(frozen=True)
class DateFormats:
    """Formats of a column in order of use; ``whole`` if the first of them parses every cell."""

    names: tuple[str, ...]
    whole: bool


def find_formats(df: DataFrame, cols: list[str]) -> dict[str, DateFormats]:
    """Formats of every text column, from one aggregation over the table.

    If formats parse all cells that are not blank, the first of them in the list reads the column. Otherwise every format that
    parses some cell is used, in the order of the list; of two rivals, which differ in the order of day and month, only the one
    that parses more cells (the earlier on equality), so that one column never mixes both readings.
    """
    if not cols:
        return {}
    cells = df.select(*[F.expr(_clean(f"CAST({_quoted(c)} AS STRING)")).alias(f"c{i}") for i, c in enumerate(cols)])
    bits = cells.select(*[
        F.expr(f"CASE WHEN c{i} IS NOT NULL THEN " + " + ".join(f"CASE WHEN ({_parsed(k, f'c{i}')}) IS NOT NULL THEN {1 << k} ELSE 0 END" for k in range(len(FORMATS))) + " END").alias(f"b{i}")
        for i in range(len(cols))])
    aggs = {}
    for i in range(len(cols)):
        aggs[f"all{i}"] = F.bit_and(f"b{i}")
        aggs |= {f"n{i}_{k}": F.count_if(F.col(f"b{i}").bitwiseAND(F.lit(1 << k)) != 0) for k in range(len(FORMATS))}
    got = one_row(bits, aggs)
    out = {}
    for i, c in enumerate(cols):
        every = got[f"all{i}"] or 0
        counts = {name: got[f"n{i}_{k}"] for k, name in enumerate(_NAMES)}
        whole = [name for k, name in enumerate(_NAMES) if every >> k & 1]
        lost = {b if counts[a] >= counts[b] else a for a, b in RIVALS}
        out[c] = DateFormats((whole[0],), True) if whole else DateFormats(tuple(n for n in _NAMES if counts[n] and n not in lost), False)
    return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def parse(name: str, formats: DateFormats) -> Column:
    """A text column as timestamps; cells that none of the formats reads are null."""
    if not formats.names:
        return F.lit(None).cast("timestamp")
    cell = _clean(f"CAST({_quoted(name)} AS STRING)")
    tries = ", ".join(_parsed(_NAMES.index(n), "x") for n in formats.names)
    return F.expr(f"transform(array({cell}), x -> coalesce({tries}))[0]")


def parse_columns(df: DataFrame, cols: list[str], formats: dict[str, DateFormats] | None = None) -> DataFrame:
    """``df`` with the text columns replaced by timestamps; typed columns are cast."""
    text = [c for c in cols if dict(df.dtypes)[c] == "string"]
    formats = find_formats(df, text) if formats is None else formats
    return df.withColumns({c: parse(c, formats[c]) if c in text else col(c).cast("timestamp") for c in cols})
