"""Spark jobs for cohort studies: subject tables, sensor series, ordinal scoring."""
