"""Multi-label dataset preparation and evaluation, and training-data operators, on Spark DataFrames."""
