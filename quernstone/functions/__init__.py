"""Column-level functions (JVM expressions) and the few Arrow UDFs that need Python."""
