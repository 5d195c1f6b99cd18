"""Operations of a training-data pipeline: deduplication, quality, privacy, packing and archives.

Nothing else in the library imports this subpackage.
"""

from beaconaudit.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
