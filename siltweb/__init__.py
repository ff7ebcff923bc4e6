"""Web-document analytics on Spark: URLs, pages, HTML nodes, links, feeds and hits as rows."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
