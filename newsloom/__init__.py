"""Content analytics on Spark: articles, feeds, pages and their sources as tables."""
