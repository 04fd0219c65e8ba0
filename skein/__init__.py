"""skein: a retrieval and analytics engine over tables of vectors, text, metadata and graphs, on Spark."""
