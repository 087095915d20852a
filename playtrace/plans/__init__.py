from playtrace.plans.folder import (
    FolderResult,
    Step,
    clean_table,
    events_of,
    merge_folder,
    process_folder,
    split_table,
)

__all__ = [
    "FolderResult",
    "Step",
    "clean_table",
    "events_of",
    "merge_folder",
    "process_folder",
    "split_table",
]
