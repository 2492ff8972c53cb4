"""Page-to-document processing and relational roll-ups on PySpark."""
