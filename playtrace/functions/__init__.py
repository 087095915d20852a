from playtrace.functions.numbers import ratio
from playtrace.functions.params import is_blank, parse_params, repair_quotes, unwrap_braces

__all__ = ["is_blank", "parse_params", "ratio", "repair_quotes", "unwrap_braces"]
