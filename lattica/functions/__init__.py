"""Element functions, reductions and sequence functions over values."""

from lattica.functions.elements import ELEMENTS
from lattica.functions.reductions import REDUCTIONS
from lattica.functions.sequences import SEQUENCES

#: Names of recorded expressions' methods, and the functions they stand for.
METHODS: dict[str, str] = {
    "Sum": "sum", "Prod": "prod", "Max": "max", "Min": "min", "Mean": "mean", "Median": "median", "Std": "std", "Any": "any", "All": "all", "Argmax": "argmax", "Argmin": "argmin",
    "Count": "count", "Set": "set", "Argunique": "argunique", "First": "first", "CountDistinct": "count_distinct", "Pos": "pos", "CumSum": "cumsum", "Argsort": "argsort", "Rank": "rank", "Sorted": "sorted",
    "Log": "log", "Log2": "log2", "Log10": "log10", "Sqrt": "sqrt", "Abs": "abs", "Upper": "upper", "Lower": "lower", "Like": "like", "HasPattern": "has_pattern",
    "SplitOnPattern": "split_on_pattern", "IsMissing": "is_missing", "ReplaceMissing": "replace_missing", "In": "in", "Contains": "contains", "Merge": "merge", "Cast": "cast",
    "Len": "len", "Pack": "pack", "Field": "field", "Each": "each",
}

__all__ = ["ELEMENTS", "METHODS", "REDUCTIONS", "SEQUENCES"]
