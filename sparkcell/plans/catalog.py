"""All registered queries of the count-data operators: name -> (query, SQL or None)."""

from . import kernels, regressions, tables, vectors

QUERIES = {**tables.QUERIES, **vectors.QUERIES, **regressions.QUERIES, **kernels.QUERIES}
