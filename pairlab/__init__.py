"""pairlab: Spark-native curation of rated sentence-pair datasets.

Every operator is a function from DataFrame(s) to DataFrame built on Spark SQL
expressions, aggregates, windows and joins.  Sub-packages:

* ``sources``   – delimited readers/writers, split catalogue, NaN clean-up
* ``functions`` – Column expressions (tokenisers, sentences, ROUGE, BLEU)
* ``operators`` – DataFrame -> DataFrame operators (dedupe, split, matching, ...)
* ``plans``     – end-to-end builds and the registered query catalogue
"""

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (the LCS pandas UDF,
# batch_apply's mapInPandas wrapper and user callables defined here) are
# pickled by value, so executors need no installed copy of the package.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
