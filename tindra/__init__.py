"""tindra: company-evidence analytics and data preparation on Spark DataFrames.

Operators are functions from DataFrames (and parameters) to a DataFrame.  They
only build plans, except where a docstring says that a model is fitted or a
frame is checkpointed.
"""

__version__ = "0.1.0"
