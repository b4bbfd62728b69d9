"""Unbounded generation: the rows of a plan as a Structured Streaming source."""

from ..operators.generate import stream_rows

__all__ = ["stream_rows"]
