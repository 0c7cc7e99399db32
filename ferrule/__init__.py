"""Program-fact analytics expressed as Spark DataFrames."""
