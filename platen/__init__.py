"""Print-sheet planning, raster and telemetry operators as Spark DataFrame jobs."""
