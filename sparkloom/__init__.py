"""Knowledge analytics on Spark: ingest, chunk, index, search and maintain document collections."""
