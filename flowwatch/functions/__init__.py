"""Column expressions: JVM-side scalar building blocks."""
