"""Python code that runs on executors travels with the job."""

import sys

from pyspark import cloudpickle


def by_value(*modules: str) -> None:
    """Pickle these modules' functions by value, so executors need not have the package installed."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])
