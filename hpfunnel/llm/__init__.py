"""Operators of a large-scale training-data pipeline.

Thirteen operators over documents, pages, embeddings and conversations, one module each:

* ``licences``     positional rare-token licence scan
* ``exact_dedup``  two-pass Bloom exact dedup (native)
* ``secrets``      zstandard-novelty secret scan
* ``urls``         bit-parallel glob filter for urls
* ``mixing``       entropy-balanced source mixing (native)
* ``packing``      dominance reduction and best-fit packing
* ``topk``         exact top-k inner products over KD-trees
* ``near_dedup``   Order MinHash near-duplicate classes
* ``langid``       error-correcting-output-code language ID
* ``toxicity``     boosted trees over dense features, isotonic scores
* ``trie``         conversation prefix trie out of double-array tries
* ``ranked``       ranked lexical search over hashed max-sketches
* ``decontaminate`` benchmark passages by a broadcast hash set of n-grams

``queries`` registers one query an operator.  Nothing else in the library
imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
