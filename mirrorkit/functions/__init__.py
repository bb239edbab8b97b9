"""Column expressions. All of them are built-in Spark expressions, so they stay inside code generation."""
