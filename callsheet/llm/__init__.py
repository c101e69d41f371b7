"""Operators for preparing large text corpora: quality rules and classifier,
source mixing, decontamination, deduplication, sharding, licence, toxicity and
language recognition. Every operator takes and returns DataFrames; see
``queries.py`` for their registered queries."""

import sys

from pyspark import cloudpickle

# Tasks carry the helpers they use, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
