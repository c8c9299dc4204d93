"""Frame analytics on Spark: detections, regions, tracks, runs and pixel planes as DataFrames."""
