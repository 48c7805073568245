"""lectern: document-review analytics as lazy Spark DataFrame plans."""
