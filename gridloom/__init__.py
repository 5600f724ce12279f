"""gridloom: lattice-field analytics as Spark plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel with their code, so a cluster needs no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
