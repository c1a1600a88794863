"""Trail-route analytics on Spark: DataFrame in, DataFrame out."""
