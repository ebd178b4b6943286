"""Access reviews on Spark: match system accounts to employees, score risk, consolidate and review.

Every public function takes DataFrames (or paths) and returns lazy DataFrames.
"""

__version__ = "0.1.0"
