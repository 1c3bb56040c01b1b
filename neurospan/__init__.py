"""neurospan: a PySpark-native engine for connectome tables, graphs, logs and label geometry."""
