"""erario: public-budget amendment analytics written as Spark jobs.

``functions``  column expressions (Column in, Column out)
``operators``  relational operators (DataFrame in, DataFrame out)
``sources``    readers and writers
``plans``      table views, end-to-end jobs, the registered queries and their SQL twins
``streaming``  incremental landing of new pages
"""

import sys

from pyspark import cloudpickle

# Tasks carry the few Python functions they run, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
