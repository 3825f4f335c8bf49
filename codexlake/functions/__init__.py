"""Column functions: plain expressions wherever Spark has the parts, Arrow UDFs for Unicode folding and alignment."""
