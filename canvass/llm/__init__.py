"""Operators of a training-data pipeline: cleaning, deduplication, scoring and packing of documents.

Nothing outside this package imports it. Each operator takes a DataFrame and
the names of its id and text columns, and works on projections of them, so
further columns of any name pass it by unseen.
"""

from pyspark import cloudpickle

import canvass

# Functions travel to the executors inside their tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(canvass)
