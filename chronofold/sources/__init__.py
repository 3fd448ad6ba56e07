"""Tables on shared storage: the event log, the versioned store, and the commit log under both."""

from .commits import CommitLog, Corrupted
from .event_log import EventLog
from .event_stream import EventStream
from .files import file_statistics, read_fixed, with_bloom
from .store import Store, WriteBatch

__all__ = ["CommitLog", "Corrupted", "EventLog", "EventStream", "Store", "WriteBatch", "file_statistics", "read_fixed", "with_bloom"]
