"""pagequarry: page-layout analytics on Spark, declared as DataFrame and SQL plans."""
