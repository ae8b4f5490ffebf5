"""Event analytics on Spark: operators, queries and streams over event envelopes."""
