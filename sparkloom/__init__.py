"""sparkloom: project memory, retrieval, code-graph and corpus operators for PySpark.

Every public operator is a function from DataFrames to DataFrames.  Nothing in
the library reads the wall clock: callers pass ``now`` where a rule needs it.
"""
__version__ = "0.1.0"
