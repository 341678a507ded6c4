"""loomwright: catalog ingestion, retrieval and session analytics as Spark jobs."""
