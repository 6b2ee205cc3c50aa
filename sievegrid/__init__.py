"""sievegrid: message analytics and corpus preparation as Spark DataFrame jobs."""
