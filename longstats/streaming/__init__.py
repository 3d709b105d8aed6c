"""Structured Streaming forms of the load and of the roll-up."""

from longstats.streaming.landing import drop_stream, land_stream
from longstats.streaming.rollup import StreamReport, merge_groups, rollup_stream

__all__ = ["StreamReport", "drop_stream", "land_stream", "merge_groups", "rollup_stream"]
