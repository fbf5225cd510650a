"""Training-data operators: one module per operator, ``queries.py`` registers
one query ``opN_<name>`` for each.  Nothing outside this folder imports it.

Task code is pickled by value, so executors need the installed public libraries
only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
