"""tessera: composable Spark DataFrame operators for tabular analytics and statistics."""
