"""Form-record and raster analytics on Spark."""
