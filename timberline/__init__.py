"""timberline: LogQL-style analytics over log lines, compiled to Spark DataFrames."""
