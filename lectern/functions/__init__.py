"""Column -> Column functions (JVM-side, codegen'd built-ins only)."""
