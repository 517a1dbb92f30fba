"""Ready-made plans: the batch pipeline, and the registered queries with their check SQL."""
