"""A document and table analytics engine declared with the PySpark DataFrame and SQL API."""
