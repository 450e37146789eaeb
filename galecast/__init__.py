"""galecast: climate and hazard analytics on Spark."""
