"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage.  Its functions run in
Python workers, so its modules are pickled by value and the executors need no
copy of the package.
"""

import importlib

from pyspark import cloudpickle

for _name in ("common", "hashing", "ann", "secrets", "quality", "langid", "mixing", "urls", "urlwords", "decontam", "html", "simhash", "toxicity"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
