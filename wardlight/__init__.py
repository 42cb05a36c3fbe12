"""wardlight: civic and geospatial analytics as Spark DataFrame operators."""
