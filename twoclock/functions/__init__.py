from .clocks import instant, instant_column, end_of_day
from .expressions import ExpressionError, arithmetic, references
from .scalars import fresh_id, json_row, num_nonnulls, stable_id, uri_slug, words

__all__ = [
    "instant", "instant_column", "end_of_day", "ExpressionError", "arithmetic",
    "references", "fresh_id", "json_row", "num_nonnulls", "stable_id", "uri_slug", "words",
]
