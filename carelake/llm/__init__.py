"""Training-data operators; queries and oracles are in ``carelake.llm.queries``.

Task functions travel by value, so executors need the public packages only and not a copy
of this one on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
