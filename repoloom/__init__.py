"""Code-corpus analytics as plain PySpark DataFrame transformations."""
