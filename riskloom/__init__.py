"""Financial-risk analytics as composable Spark DataFrame operators."""
