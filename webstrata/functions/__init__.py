"""Column expressions: each takes and returns ``Column`` and stays JVM-side."""
