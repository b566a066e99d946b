"""Commercial analytics for distributor data, expressed as Spark DataFrame plans."""
