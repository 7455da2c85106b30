"""Column expressions: no job, no shuffle, nothing leaves the JVM."""
