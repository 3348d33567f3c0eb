"""Training-data operators. Nothing else in the library imports this subpackage."""

import corpusflow
from pyspark import cloudpickle

# Worker functions travel with the job, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(corpusflow)
