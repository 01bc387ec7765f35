"""Text moderation and audit analytics on Spark.

Lexicons, allowlists, policies and messages are DataFrames; every operator is a
function from DataFrames to a DataFrame, so Catalyst plans the whole query.
"""

import sys

from pyspark import cloudpickle

# Python workers get the code of Arrow functions with the task, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
