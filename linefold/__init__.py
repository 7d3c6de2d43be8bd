"""Log ingestion, reduction and delivery as Spark DataFrame functions."""
