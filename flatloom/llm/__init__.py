"""Operators of a training-data pipeline over `documents`, `embeddings` and `pages`.

Nothing outside this package and `corpus_pipeline.py` imports it. Each operator is a function
from DataFrames to a DataFrame; `queries` holds the thin registered queries.
"""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
