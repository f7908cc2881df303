"""pairwell: cohort-matching analytics over claims-style data, as Spark jobs.

Every public function takes DataFrames and returns DataFrames.  Options are
keyword arguments; there is no module state.
"""
