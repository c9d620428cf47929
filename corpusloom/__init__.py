"""corpusloom: a PySpark-native analytics engine for web-scale text corpora.

Every operator takes and returns DataFrames.  Relational work stays in Catalyst; text semantics
that Spark has no expression for run as Arrow batches in Python workers.
"""

__version__ = "0.1.0"
