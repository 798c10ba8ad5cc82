"""quire: analytics over a corpus of scholarly papers, as Spark jobs.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing runs until the caller acts on the result, except where a
docstring says that a fitted table is written first.
"""

__version__ = "0.1.0"
