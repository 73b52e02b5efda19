"""caseloom: Spark jobs for large tables of short free-text reports.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns. Nothing is run eagerly except where a function's name says so
(``assert_*``, ``write_*``, ``fit_*``, ``train_*``, ``run_*``).
"""

__version__ = "0.1.0"
