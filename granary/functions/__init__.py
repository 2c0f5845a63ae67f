"""Column functions: paths, globs, and how sizes and times are shown."""
