"""Clinical time-series analytics on Spark, and training-data operators beside it."""
