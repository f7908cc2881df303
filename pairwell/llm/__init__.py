"""Operators that prepare text for language-model training, as Spark jobs.

Each module holds one operator; ``queries`` registers them over the tables.
Nothing else in the library imports this package.
"""
