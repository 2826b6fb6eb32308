"""Column-building functions: text, places, thresholds, labels."""
