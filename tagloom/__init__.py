"""Engineering-document and plant-event analytics on PySpark DataFrames."""
