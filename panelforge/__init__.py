"""Factor analytics on panel data, compiled to Spark DataFrame plans."""
