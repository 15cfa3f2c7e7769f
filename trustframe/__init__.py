"""Facts about tables before you trust them: profiles, keys, joins, key numbers, anomalies, drift and text links."""

import sys

from pyspark import cloudpickle

from .session import build_session, work_dir
from .tables import Table, TableSet

__all__ = ["Table", "TableSet", "build_session", "work_dir"]

# functions sent to executors carry their code along, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
