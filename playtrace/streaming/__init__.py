from playtrace.streaming.exports import Ingested, export_stream, first_copies, ingest

__all__ = ["Ingested", "export_stream", "first_copies", "ingest"]
