"""Road-sensor analytics on Spark: lake, warehouse models, reports, model and drift jobs."""
