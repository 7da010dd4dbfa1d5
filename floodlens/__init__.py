"""floodlens: Spark-native analytics for packet-flood detection and forensics.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from Spark SQL expressions, window functions,
aggregations and joins.  Python workers are used only for the greedy
chains (throttling, the mitigation cycle) and the stateful streaming
processors.
"""

from floodlens.config import Dims, Thresholds

__all__ = ["Dims", "Thresholds"]
__version__ = "0.1.0"
