"""quillsieve: query-aware context compression and corpus preparation on PySpark."""
