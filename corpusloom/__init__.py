"""corpusloom: text-corpus building expressed as Spark DataFrame plans.

functions/  Column builders (scalar text rules, line predicates)
operators/  DataFrame -> DataFrame operators
sources/    readers and sinks
plans/      composed pipelines and the registered queries with their SQL
streaming/  the cleaning pipeline on a file stream
llm/        operators for training-data pipelines (optional: nothing else imports it)
"""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
