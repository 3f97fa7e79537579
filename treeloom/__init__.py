"""treeloom: source trees, documents and their history as Spark tables."""
