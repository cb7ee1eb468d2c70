"""Operators that prepare training data for language models.

Functions that run inside tasks are shipped by value, so executors need this
package neither installed nor on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
