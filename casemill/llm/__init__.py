"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
column names, returns DataFrames, and leaves scheduling to Spark.
"""
