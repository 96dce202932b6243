"""Part of fieldloom, a Spark engine that harmonises observation datasets."""
