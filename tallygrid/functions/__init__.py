"""Column expressions: everything here stays inside the JVM and whole-stage code generation."""
