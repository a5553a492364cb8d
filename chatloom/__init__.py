"""Spark jobs over the logs of conversational agents."""
