"""Progress while something runs, and stopping it."""
