"""Reading input files and writing result tables."""
from tabscope.sources.readers import (
    dataset_metadata,
    detect_file_type,
    file_metadata,
    load,
    require_rows,
    sample_rows,
)
from tabscope.sources.writers import results_as_json, write_results

__all__ = [
    "dataset_metadata", "detect_file_type", "file_metadata", "load", "require_rows",
    "sample_rows", "results_as_json", "write_results",
]
