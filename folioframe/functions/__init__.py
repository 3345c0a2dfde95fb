"""Column -> Column expressions; JVM-side unless their docstring says otherwise."""
