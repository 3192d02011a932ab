"""quire: PDF corpora as relational tables, on Spark."""
