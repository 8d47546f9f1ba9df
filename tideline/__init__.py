"""Event-impact analytics over dated, grouped texts and scores, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tideline.design import StudyDesign, WindowSpan
from tideline.session import build_session

# Functions of this package travel to the workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["StudyDesign", "WindowSpan", "build_session"]
