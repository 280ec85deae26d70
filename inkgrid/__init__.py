"""inkgrid: a Spark-native dataflow engine for pages, text regions, masks and recognised text."""
