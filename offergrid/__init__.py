"""offergrid: retail price and availability snapshots as Spark DataFrame jobs."""
