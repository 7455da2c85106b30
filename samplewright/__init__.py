"""Sample-set preparation and distribution metrics as Spark jobs."""
