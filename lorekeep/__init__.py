"""Knowledge-base, conversation, commerce and telemetry operators on Spark DataFrames."""
