"""Spreadsheet logic re-aimed onto a cell table (GRD1-GRD9).

A workbook is a DataFrame of cells ``(sheet, row_idx, col_idx, value)``;
positions are data, never file order.  Header detection is a filter plus a
grouped count and a ``min`` per sheet; applying a header is a join of the
cells with the header cells on ``(sheet, col_idx)``.  The per-sheet header
tables have one row per sheet / per header cell, far smaller than the
cells; Spark (with AQE) broadcasts them when small and otherwise splits a
hot sheet's partition with the skew-join rule.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.columns import try_number

CELL_COLS = ("sheet", "row_idx", "col_idx", "value")

# Tokens treated as missing when landing text, characters
# removed from column names, and the name used for an empty header.
NULL_TOKENS = ("", "nan", "None", ".")
NAME_DROP_CHARS = ",;{}()\n\t="
EMPTY_NAME = "col"


def _text(c: str | Column = "value") -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c)


def non_empty(c: str | Column = "value") -> Column:
    t = _text(c)
    return t.isNotNull() & (t != "")


def is_numeric_text(c: str | Column = "value") -> Column:
    """Digits, dots and dashes only, with at least one digit."""
    t = _text(c)
    return t.rlike(r"^[0-9.\-]+$") & t.rlike(r"[0-9]")


def detect_header(cells: DataFrame, k: int = 3, within: int = 20) -> DataFrame:
    """GRD1: per sheet, the first row (among the first ``within``) with at
    least ``k`` non-empty cells that are not purely numeric."""
    texty = cells.filter((F.col("row_idx") < within) & non_empty() & ~is_numeric_text())
    counts = texty.groupBy("sheet", "row_idx").agg(F.count(F.lit(1)).alias("n"))
    return (counts.filter(F.col("n") >= k).groupBy("sheet")
            .agg(F.min("row_idx").alias("header_row")))


def detect_period_header(cells: DataFrame, within: int = 15) -> DataFrame:
    """GRD2: per sheet, the first row (among the first ``within``) holding a
    cell that starts with four digits, or contains '-' and is at most 7 long."""
    t = _text()
    hit = t.rlike(r"^[0-9]{4}") | (t.contains("-") & (F.length(t) <= 7))
    return (cells.filter((F.col("row_idx") < within) & F.col("value").isNotNull() & hit)
            .groupBy("sheet").agg(F.min("row_idx").alias("header_row")))


def apply_header(cells: DataFrame, headers: DataFrame, ignore_first: bool = False,
                 unique: bool = False) -> DataFrame:
    """GRD3: the cells under each sheet's header, labelled with the header
    text, as ``(sheet, row_idx, col_idx, column, value)``.

    Rows with no non-empty cell are dropped; with ``ignore_first`` a row also
    needs a non-empty cell beyond column 0.  With ``unique`` the labels of a
    sheet are storage-safe and all different (GRD8), blank ones included.
    """
    h = headers.select("sheet", "header_row")
    cells_h = cells.join(h, "sheet")
    names = (cells_h.filter(F.col("row_idx") == F.col("header_row"))
             .select("sheet", "col_idx", _text().alias("column")))
    body = (cells_h.filter(F.col("row_idx") > F.col("header_row"))
            .select("sheet", "row_idx", "col_idx",
                    F.when(non_empty(), F.col("value")).alias("value")))
    live = F.col("value").isNotNull()
    if ignore_first:
        live = live & (F.col("col_idx") > 0)
    # one window partition per spreadsheet row: bounded by the sheet's width
    row = Window.partitionBy("sheet", "row_idx")
    kept = (body.withColumn("_live", F.max(live.cast("int")).over(row))
            .filter(F.col("_live") == 1))
    if unique:
        # a column without a header cell counts as a blank one; a sheet's labels are one small group
        every = kept.select("sheet", "col_idx").distinct().unionByName(names.select("sheet", "col_idx")).distinct()
        heads = (every.join(names, ["sheet", "col_idx"], "left").groupBy("sheet")
                 .agg(F.array_sort(F.collect_list(F.struct("col_idx", "column"))).alias("heads")))
        names = (heads.withColumn("_named", unique_labels(F.transform("heads", lambda x: x["column"])))
                 .select("sheet", F.explode(F.arrays_zip(F.transform("heads", lambda x: x["col_idx"]).alias("c"),
                                                         F.col("_named").alias("n"))).alias("z"))
                 .select("sheet", F.col("z.c").alias("col_idx"), F.col("z.n").alias("column")))
    return (kept.join(names, ["sheet", "col_idx"], "left")
            .withColumn("column", F.when(non_empty("column"), F.col("column"))
                        .otherwise(F.lit(EMPTY_NAME)))
            .select("sheet", "row_idx", "col_idx", "column", "value"))


def unique_labels(labels: Column) -> Column:
    """:func:`sanitize_names` of an array of labels as one expression."""
    drop = "[" + re.escape(NAME_DROP_CHARS) + "]"
    clean = F.transform(labels, lambda x: F.trim(F.regexp_replace(
        F.regexp_replace(F.coalesce(x, F.lit("")), drop, ""), r"[\s_]+", " ")))
    clean = F.transform(clean, lambda x: F.when(x == "", F.lit(EMPTY_NAME)).otherwise(F.replace(x, F.lit(" "), F.lit("_"))))

    def free(acc, x):
        used = F.transform(acc, lambda y: F.lower(y))
        tries = F.transform(F.sequence(F.lit(1), F.size(clean) * 2), lambda i: F.concat(x, F.lit("_"), i.cast("string")))
        wanted = F.transform(clean, lambda y: F.lower(y))
        fits = F.filter(tries, lambda t: ~F.array_contains(used, F.lower(t)) & ~F.array_contains(wanted, F.lower(t)))
        return F.concat(acc, F.array(F.when(F.array_contains(used, F.lower(x)), F.get(fits, F.lit(0))).otherwise(x)))

    return F.aggregate(clean, F.array().cast("array<string>"), free)


def rows_as_maps(long: DataFrame) -> DataFrame:
    """``(sheet, row_idx, record map<column, value>)``; one group per row,
    bounded by the sheet's width."""
    return long.groupBy("sheet", "row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("record"))


def column_names(long: DataFrame, index: Sequence[str] = ("sheet", "row_idx")) -> list[str]:
    """The columns of the wide form of ``long``, by their first place in a sheet.

    One row per distinct name comes to the driver, which is the schema of the
    wide table; names that differ in case only are one column, as in a table.
    """
    first = (long.groupBy(F.lower("column").alias("k"))
             .agg(F.min(F.struct("col_idx", "sheet", "column")).alias("at")))
    taken = {c.lower() for c in index}
    return [r["column"] for r in first.orderBy("at.col_idx", "at.sheet", "k").select("at.column").collect()
            if r["column"].lower() not in taken]


def to_wide(long: DataFrame, columns: Sequence[str] | None = None,
            index: Sequence[str] = ("sheet", "row_idx")) -> DataFrame:
    """GRD3, wide: one row per spreadsheet row and one column per header name.

    ``long`` is the output of :func:`apply_header` with ``unique=True``, so a row
    holds a name once.  Sheets with different headers are united by name: a
    column that a sheet lacks is NULL there.  A row's cells become one map
    (bounded by the sheet's width) in a single grouping, whatever the number of columns.
    """
    names = list(columns) if columns is not None else column_names(long, index)
    cells = F.map_from_entries(F.collect_list(F.struct(F.lower("column"), "value")))
    rows = long.groupBy(*index).agg(cells.alias("_cells"))
    return rows.select(*index, *[F.try_element_at("_cells", F.lit(n.lower())).alias(n) for n in names])


def sheet_table(cells: DataFrame, headers: DataFrame | None = None, k: int = 3, within: int = 20,
                ignore_first: bool = True) -> DataFrame:
    """GRD1 + GRD3 + GRD9: the labelled cells of all sheets that have a header row."""
    heads = detect_header(cells, k, within) if headers is None else headers
    return normalize_nulls(apply_header(cells, heads, ignore_first=ignore_first, unique=True), ["value"])


def save_sheets(cells: DataFrame, path: str, rules: Mapping[str, Iterable[str]], default: str,
                exclude: Iterable[str] = (), k: int = 3, within: int = 20) -> dict[str, str]:
    """GRD1-3, GRD6-9 as one chain: parse every sheet, route it, save one wide table per category.

    The labelled cells are written once, dealt out by category below
    ``path/cells``; each category's table is then built from its own part, with
    the columns of its own sheets, and saved as ``path/<category>``.
    Returns category -> folder, for the categories that have rows.
    """
    long = route_sheets(sheet_table(cells, k=k, within=within), rules, default, exclude)
    kept = ["sheet", "row_idx", "col_idx", "column", "value"]
    (long.select("data_category", *kept).hint("rebalance", "data_category")
     .write.mode("overwrite").partitionBy("data_category").parquet(f"{path}/cells"))
    stored = long.sparkSession.read.parquet(f"{path}/cells")
    out = {}
    for category in [*rules, default]:
        part = stored.filter(F.col("data_category") == category).select(*kept)
        names = column_names(part)
        if names:
            out[category] = f"{path}/{category}"
            wide = to_wide(part, names).withColumnRenamed("sheet", "source_sheet")
            wide.withColumn("data_category", F.lit(category)).write.mode("overwrite").parquet(out[category])
    return out


def label_from_name(name: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First rule whose text occurs in ``lower(name)`` gives the label."""
    out = F.lit(default)
    for needle, label in reversed(list(rules)):
        out = F.when(F.lower(name).contains(needle.lower()), F.lit(label)).otherwise(out)
    return out


def melt_grid(cells: DataFrame, header_row: int = 0, first_row: int = 3,
              skip: str = "NOTES", label_rules: Sequence[tuple[str, str]] = (),
              default_label: str | None = None, digits: int = 2,
              names: Sequence[str] = ("year_period", "city", "price_cpl", "fuel_type")) -> DataFrame:
    """GRD4: fixed-layout sheet -> long rows.

    Row ``header_row`` holds the series names from column 1 on; data rows
    start at ``first_row`` with the period in column 0.  Sheets whose name
    contains ``skip`` (any case) are ignored, non-numeric values dropped,
    values rounded half-even, and a label derived from the sheet name.
    """
    period_n, series_n, value_n, label_n = names
    c = cells.filter(~F.upper(F.col("sheet")).contains(skip.upper()))
    heads = (c.filter((F.col("row_idx") == header_row) & (F.col("col_idx") >= 1) & non_empty())
             .select("sheet", "col_idx", _text().alias(series_n)))
    periods = (c.filter((F.col("row_idx") >= first_row) & (F.col("col_idx") == 0) & non_empty())
               .select("sheet", "row_idx", _text().alias(period_n)))
    vals = (c.filter((F.col("row_idx") >= first_row) & (F.col("col_idx") >= 1))
            .select("sheet", "row_idx", "col_idx", try_number(_text(), "double").alias("_v"))
            .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    out = vals.join(periods, ["sheet", "row_idx"]).join(heads, ["sheet", "col_idx"])
    label = label_from_name(F.col("sheet"), label_rules, default_label) if label_rules or default_label \
        else F.col("sheet")
    return out.select(period_n, series_n, F.bround("_v", digits).alias(value_n), label.alias(label_n))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "variable",
            val: str = "value") -> DataFrame:
    """GRD5: wide -> long, dropping NULL values."""
    return df.unpivot(list(ids), list(cols), var, val).where(F.col(val).isNotNull())


def route_sheets(df: DataFrame, rules: Mapping[str, Iterable[str]], default: str,
                 exclude: Iterable[str] = (), sheet: str = "sheet",
                 category: str = "data_category") -> DataFrame:
    """GRD6: drop excluded sheets, tag the rest with a category."""
    cat = F.lit(default)
    for name, sheets in reversed(list(rules.items())):
        cat = F.when(F.col(sheet).isin(list(sheets)), F.lit(name)).otherwise(cat)
    return (df.filter(~F.col(sheet).isin(list(exclude)))
            .withColumn("source_sheet", F.col(sheet)).withColumn(category, cat))


def split_by(df: DataFrame, key: str, mapping: Mapping[str, str]) -> dict[str, DataFrame]:
    """GRD7: one DataFrame per target name; key values without rows simply
    give an empty frame (a missing sheet is skipped, not an error)."""
    return {target: df.filter(F.col(key) == value) for value, target in mapping.items()}


def write_split(df: DataFrame, key: str, mapping: Mapping[str, str], path: str,
                fmt: str = "parquet") -> None:
    """GRD7 as one job: rows of mapped key values written to one folder per
    target name (``path/table=<name>``); other key values are skipped."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    (df.withColumn("table", m[F.col(key)]).filter(F.col("table").isNotNull()).hint("rebalance", "table")
     .write.mode("overwrite").partitionBy("table").format(fmt).save(path))


def sanitize_names(names: Sequence[str]) -> list[str]:
    """GRD8: storage-safe column names.

    trim -> drop ``, ; { } ( ) \\n \\t =`` -> whitespace runs to ``_`` ->
    collapse ``_`` -> strip ``_`` -> empty becomes ``col``.  Duplicates get
    ``_1``, ``_2``... (case-insensitive, skipping suffixes already taken).
    """
    drop = dict.fromkeys(map(ord, NAME_DROP_CHARS))
    blank = str.maketrans("_", " ")
    parts = [str(n).strip().translate(drop).translate(blank).split() for n in names]
    return unique_names(["_".join(p) or EMPTY_NAME for p in parts])


def unique_names(names: Sequence[str]) -> list[str]:
    """Each first use of a name stays; later ones get the least free suffix."""
    wanted = {n.lower() for n in names}
    used: set[str] = set()
    out = []
    for n in names:
        options = itertools.chain([n], (f"{n}_{i}" for i in itertools.count(1)))
        pick = next(x for x in options
                    if x.lower() not in used and (x == n or x.lower() not in wanted))
        used.add(pick.lower())
        out.append(pick)
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    """GRD8 on a DataFrame: a metadata-only rename."""
    return df.toDF(*sanitize_names(df.columns))


def normalize_nulls(df: DataFrame, cols: Sequence[str] | None = None,
                    tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """GRD9: blank and placeholder text (``''``, ``nan``, ``None``, ``.``) -> NULL."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    targets = [c for c in (cols or strings)]
    return df.withColumns({c: F.when(F.trim(F.col(c)).isin(list(tokens)), F.lit(None))
                           .otherwise(F.col(c)) for c in targets})
