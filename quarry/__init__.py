"""quarry: analytics over a corpus of documents, written for Spark."""
