"""plans of the program-fact engine."""
