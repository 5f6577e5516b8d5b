"""barflow: market time series and the text around them, as Spark DataFrame functions."""
