"""Analytics over multi-band raster images, as Spark DataFrames."""
