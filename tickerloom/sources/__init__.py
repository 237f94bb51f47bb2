"""Tables in and out."""

from tickerloom.sources.io import Config, MarketStore, read_candidates, read_closes, read_decision_inputs, read_snapshot
from tickerloom.sources.provenance import RunContext
from tickerloom.sources.tables import VersionedTable

__all__ = ["Config", "MarketStore", "RunContext", "VersionedTable", "read_candidates", "read_closes", "read_decision_inputs", "read_snapshot"]
