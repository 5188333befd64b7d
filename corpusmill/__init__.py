"""corpusmill: research-corpus analytics on PySpark."""
