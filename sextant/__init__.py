"""sextant: a code-intelligence and data-processing engine built on PySpark.

Tables are Parquet snapshots; operators are functions from DataFrame to DataFrame.
The subpackage ``llm`` is optional: nothing outside it imports it.
"""
