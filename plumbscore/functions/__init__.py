"""Column functions: hashing, cleaning, casting and rendering."""

from plumbscore.functions.cleaning import fill_numbers, indicator, parse_number, parse_time
from plumbscore.functions.hashing import (
    cumulative_bounds,
    hash_uniform,
    normalise_weights,
    pick_by_weight,
    weight_sum,
)
from plumbscore.functions.rendering import join_text, result_json, row_text, split_text

__all__ = [
    "cumulative_bounds",
    "fill_numbers",
    "hash_uniform",
    "indicator",
    "join_text",
    "normalise_weights",
    "parse_number",
    "parse_time",
    "pick_by_weight",
    "result_json",
    "row_text",
    "split_text",
    "weight_sum",
]
