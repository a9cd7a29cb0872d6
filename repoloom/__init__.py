"""repoloom: code-estate analytics on Spark.

Every public function takes and returns DataFrames keyed by ``repo``; one call
answers its question for one repository or for a whole estate.
"""
