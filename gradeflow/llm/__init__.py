"""Operators of a training-data pipeline.  Nothing else in the library imports
this subpackage; ``gradeflow.llm.queries`` lists its queries and their SQL."""
