"""Column expressions and the small set of distribution tails used by the tests."""
