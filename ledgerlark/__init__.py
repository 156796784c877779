"""Analytics over regulatory trade disclosures as Spark jobs."""
