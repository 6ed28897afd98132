"""Point-cloud analytics on Spark: octrees, level of detail, region queries and codecs as DataFrame plans."""
