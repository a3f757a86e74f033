"""Web-log security analytics as Spark jobs over tables and streams."""
