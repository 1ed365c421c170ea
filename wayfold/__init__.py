"""Road-passability analytics on Spark: operators, sources, plans and streams."""
