"""Column helpers; every one compiles to built-in Spark expressions."""
