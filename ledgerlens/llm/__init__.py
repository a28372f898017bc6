"""Operators for preparing training data, and their registered queries.

Nothing outside this subpackage imports it. The Python kernels are pickled by
value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle


def ship(*names: str) -> None:
    """Send the functions of the named modules with the tasks that use them."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])
