"""Feature extraction, classifiers, cascades and their evaluation on Spark ML."""
