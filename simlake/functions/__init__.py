"""Column builders over vectors; all of them stay inside the JVM."""
