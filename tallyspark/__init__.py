"""Filing analytics on Spark: composable DataFrame -> DataFrame operators."""
