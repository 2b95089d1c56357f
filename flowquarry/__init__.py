"""Network-flow analytics and intrusion scoring as Spark DataFrame jobs."""
