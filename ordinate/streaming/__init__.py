"""What works on streams: row-wise operators as they are, and keyed aggregates in event-time windows."""

from ordinate.streaming.windows import from_stream, keyed_windows

__all__ = ["from_stream", "keyed_windows"]
