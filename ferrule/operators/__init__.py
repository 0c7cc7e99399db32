"""operators of the program-fact engine."""
