"""Analytics on tables of labelled, fixed-length signals, written for Spark.

Every operator takes and returns Spark DataFrames (or Column expressions), so
the work stays inside one Catalyst plan until the caller asks for an action.
"""

from signalloom.spec import HEARTBEAT, Collection, SignalSpec

__all__ = ["HEARTBEAT", "Collection", "SignalSpec"]
