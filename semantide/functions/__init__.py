"""Column expressions; all of them stay in the JVM unless they say otherwise."""
