"""Panel analytics on Spark: functions from DataFrame to DataFrame."""
