"""PySpark operators for analysing generated texts at scale.

Every public function takes and returns DataFrames or Columns; model inference
stays outside and is attached as a batch function.
"""

from ambilens.session import get_spark

__all__ = ["get_spark"]
