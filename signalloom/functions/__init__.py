"""Column expressions; nothing in here needs a shuffle or leaves the JVM."""
