"""DataFrame operators: ranking, joins, listing search, curation, chunking, retrieval."""
