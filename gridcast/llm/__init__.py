"""Training-data operators: fingerprints, personal data, line cleaning,
licence scan, URL lists, byte BPE, line quality, secrets, packing, SimHash.

Nothing else in the library imports this subpackage. Its functions are
pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
