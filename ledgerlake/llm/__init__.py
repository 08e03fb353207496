"""Training-data operators on Spark: deduplication, decontamination,
toxicity scoring, source mixing, WARC, PII, secrets, chat formatting,
vector clusters and conversation tries.

Nothing outside this package imports it, except the registration in
``__spark_entry__`` and ``corpus_pipeline``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them: executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
