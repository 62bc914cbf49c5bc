"""Spark jobs for course catalogues: syllabi to tables, term rollover, grading and usage metrics."""
