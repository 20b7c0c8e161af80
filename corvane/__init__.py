"""A PySpark engine for navigating text and source corpora."""
