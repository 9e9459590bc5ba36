"""Message-risk analytics as Spark DataFrame operators."""
