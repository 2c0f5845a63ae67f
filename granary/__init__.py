"""Storage analytics on Spark: inventories of files, where the space goes, and what is stored twice."""
