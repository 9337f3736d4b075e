"""Conversational memory analytics on Spark DataFrames.

``sources``    read files, session workbooks, result sets and the memory table
``functions``  column expressions: text clean-up, JSON parsing, defaults, prompts
``operators``  DataFrame to DataFrame steps: similarity join, context, grading, inference
``plans``      the composed jobs: import, ingest, search, evaluate, judge
"""

import sys

from pyspark import cloudpickle

# Functions of this package run inside tasks. Shipping them by value spares installing the package on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
