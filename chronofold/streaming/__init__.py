"""Views that follow the event log, by Structured Streaming."""

from .engine import Engine, Following

__all__ = ["Engine", "Following"]
