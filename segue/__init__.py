"""Track-catalog, queue-log, signal and transition analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from segue.session import build_session

# functions run inside tasks travel with the job: executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
