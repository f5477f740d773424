"""Contact discovery over tables of web pages, as Spark jobs."""
