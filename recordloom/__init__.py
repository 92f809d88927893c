"""recordloom: cleaning, linking, de-duplicating and scoring records with Spark.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing runs until the caller triggers an action, except where a
docstring says that a stage is written down to cut the lineage.
"""
