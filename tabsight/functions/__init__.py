"""Column expressions: text, documents, keys. All stay inside the JVM."""
