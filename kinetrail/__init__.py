"""Spark-native analytics for multi-sensor trajectories: every operator is a DataFrame-to-DataFrame function."""
