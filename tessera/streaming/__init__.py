"""Change feed ingestion."""
