"""lectern: document collections, retrieval and corpus preparation on Spark."""
