from playtrace.sources.csv_files import list_csv, read_events_csv, read_raw, write_events_csv
from playtrace.sources.event_log import event_view_audit, typed_events
from playtrace.sources.split_files import stage_by_event, write_split

__all__ = [
    "event_view_audit",
    "list_csv",
    "read_events_csv",
    "read_raw",
    "stage_by_event",
    "typed_events",
    "write_events_csv",
    "write_split",
]
