"""Spark-native document analytics: parsing, retrieval, entities and metrics.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (whole pipelines and
the registered queries) and ``streaming``.  The optional sub-package ``llm``
holds training-data operators; nothing here imports it.
"""

__version__ = "0.1.0"
