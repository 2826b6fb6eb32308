"""Reading and writing of tweet, label, prediction and summary tables."""
