"""Crown-detection analytics on Spark: DataFrame operators over boxes, spans, rasters and annotation tables."""
