"""Column-level helpers: every function returns a Spark ``Column`` built from
built-in expressions, so it stays inside whole-stage codegen."""

from supplylens.functions.columns import (
    col_of,
    parse_number,
    try_number,
    is_present,
    clean_label,
    month_start,
    truncate_to,
    quarter_start,
    quarter_label,
    to_double,
    order_cols,
    order_sql,
    valid_coordinate,
    mercator_x,
    mercator_y,
)

__all__ = [
    "col_of", "parse_number", "try_number", "is_present", "clean_label", "month_start",
    "truncate_to", "quarter_start", "quarter_label", "to_double", "order_cols",
    "order_sql", "valid_coordinate", "mercator_x", "mercator_y",
]
