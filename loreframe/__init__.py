"""Knowledge-retrieval analytics on PySpark."""
