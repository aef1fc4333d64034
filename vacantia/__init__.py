"""Job-posting analytics on Spark: extraction, classification, search, audits and streams."""
