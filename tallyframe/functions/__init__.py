"""Column expressions shared by the operators (all of them JVM-side)."""
