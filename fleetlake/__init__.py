"""fleetlake: work-order analytics on Spark.

Every operator takes and returns a DataFrame and is built from Spark SQL
expressions, so the same code serves one workbook and a large archive.
"""

__all__ = ["session"]
