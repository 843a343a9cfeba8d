"""Column-returning helpers and the fixed vocabularies they use."""
