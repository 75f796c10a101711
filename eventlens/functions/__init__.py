"""Column functions: event semantics and statistics, all inside the JVM."""
