"""Column expressions (JVM side) shared by the operators."""
