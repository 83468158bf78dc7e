"""The filter language: text to syntax tree to a Catalyst column."""

from marlspike.filterlang.columns import compile_filter, filter_rows
from marlspike.filterlang.syntax import FilterError, parse, show

__all__ = ["FilterError", "compile_filter", "filter_rows", "parse", "show"]
