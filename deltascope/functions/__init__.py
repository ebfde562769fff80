"""Column expressions: predicates, coercions, opcodes."""
