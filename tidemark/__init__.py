"""Signal analytics on PySpark: text items to ranked signals and a versioned knowledge base."""
