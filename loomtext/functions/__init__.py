"""Column functions; all of them stay inside the JVM unless their module says otherwise."""
