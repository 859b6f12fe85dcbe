"""Corpus operators for training data: dedup, formatting, scoring, decontamination, tokens, search, archives.

Each module holds one operator with its own interface; ``registry`` derives the registered queries from them.
Functions that run inside tasks are pickled by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
