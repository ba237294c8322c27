"""Provider intelligence about companies as Spark jobs over crawled tables."""
