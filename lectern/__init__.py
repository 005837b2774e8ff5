"""lectern: a Spark-native engine for document-retrieval analytics.

Every operator is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function
on the public PySpark API; see ``README.md`` for the module map.
"""

from lectern.params import Params

__all__ = ["Params"]
