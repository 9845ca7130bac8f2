"""millrace: corpus curation, fact graphs and release gates as Spark plans."""
