"""heronry: analytics and corpus jobs written with the DataFrame, SQL and streaming APIs of Spark."""
