"""palaver: message analytics and text operators as plain Spark DataFrame code."""
