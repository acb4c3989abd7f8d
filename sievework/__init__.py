"""Guide-screen analytics as Spark DataFrame operators."""

import os
import sys

from pyspark import cloudpickle

# Workers import this package where PYTHONPATH has it (or --py-files brings it); elsewhere functions travel whole.
if os.path.dirname(os.path.dirname(os.path.abspath(__file__))) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
