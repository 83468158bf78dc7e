"""A Spark-first engine over the history of software projects: feeds, documents, filters, vectors, reviews."""
