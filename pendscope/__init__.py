"""pendscope: delay root-cause analytics on PySpark DataFrames.

Every operator is a plain function from DataFrame to DataFrame, so operators
chain with ``df.transform`` and Catalyst plans the whole chain at once.
"""

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of
# this package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
