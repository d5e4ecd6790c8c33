"""Reading and writing tables."""

from .models import load_model, save_model
from .nested import drop_nested_columns, flatten_records, normalize_names
from .readers import read_csv_dir, read_gold_tsv, read_scores_typed, read_table
from .sinks import split_results_errors, write_table

__all__ = [
    "drop_nested_columns", "flatten_records", "load_model", "normalize_names", "read_csv_dir",
    "read_gold_tsv", "read_scores_typed", "read_table", "save_model", "split_results_errors",
    "write_table",
]
