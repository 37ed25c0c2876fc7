"""Column expressions: calendar, numbers, labels and bins. All JVM-side built-ins."""
