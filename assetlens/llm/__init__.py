"""Training-data operators: quality, toxicity, deduplication, decontamination,
licences, packing, WARC archives, centroid clustering, chat formatting and
importance resampling. Nothing else in the library imports this
subpackage. Its functions travel to the executors by value, so a cluster needs
no installed copy of it."""

import sys

from pyspark import cloudpickle

from ..plans import scratch

cloudpickle.register_pickle_by_value(scratch)
cloudpickle.register_pickle_by_value(sys.modules[__name__])
