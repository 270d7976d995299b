"""Column expressions: paths, predicates, and transforms of lists, sets, maps and text."""
