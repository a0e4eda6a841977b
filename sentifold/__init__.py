"""Market sentiment, valuation and portfolio analytics as Spark DataFrame jobs."""
