"""quarryline: corpus analytics written as ordinary Spark jobs.

Sub-packages: ``sources`` (trees, stores, sinks), ``functions`` (column
expressions), ``operators`` (DataFrame in, DataFrame out), ``plans`` (the query
catalogue with its SQL counterparts), ``streaming`` (incremental indexing) and the
optional ``llm`` (training-data operators), which no other module imports.
"""
