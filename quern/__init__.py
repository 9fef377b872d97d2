"""Analytics engine on Apache Spark: operators are functions from DataFrame to DataFrame."""
