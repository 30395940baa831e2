"""Credit-risk analytics on loan tables of any size, as plain Spark DataFrame operators."""
