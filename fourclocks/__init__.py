"""Point-in-time analytics on Spark: every fact carries four clocks."""
