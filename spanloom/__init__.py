"""spanloom: a PySpark-native engine for comparing pinned revisions of many source collections.

Every operator is a function from DataFrames to DataFrames, keyed by ``snapshot_id`` where the
unit of work is one pinned comparison, so that one job serves any number of snapshots.
"""

__version__ = "0.1.0"
