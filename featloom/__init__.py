"""featloom: relational tables to model-ready feature matrices, on Spark.

Every operator takes and returns Spark DataFrames or Columns.  ``fit_*``
functions look at data and return a small object; everything else is lazy.
"""

__version__ = "0.1.0"
