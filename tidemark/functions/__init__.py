"""Column expressions. All of them run inside the JVM; there is no Python UDF in this package."""
