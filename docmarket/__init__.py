"""docmarket: match documents to a market of listings, as Spark DataFrame jobs."""
