"""Notice analytics on Spark: extraction, new-item detection, delivery, reports, and corpus preparation."""
