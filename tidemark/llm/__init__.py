"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; side files go to the folder named in ``spark.checkpoint.dir``.
"""
