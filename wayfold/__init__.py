"""Road-network vehicle tracking and corpus preparation as Spark plans."""
