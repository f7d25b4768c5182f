"""Operators of a training-data pipeline (mixing, line dedup, n-gram join, chat
formatting, quality classifier, personal data, decontamination, quality rules,
token attribution, license scan). Nothing else in the library imports this
package; its queries are registered by ``tieout.llm.queries``.

Functions that run inside tasks are pickled by value, so executors need
neither this package on their path nor any shipped archive.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
