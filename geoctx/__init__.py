"""geoctx: location-context analytics and labelled-data preparation on PySpark."""
