"""PySpark-native analytics for bidirected assembly graphs and text corpora."""
