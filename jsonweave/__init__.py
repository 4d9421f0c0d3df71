"""jsonweave: JSONPath and SQL analytics over very large JSON, on PySpark."""
