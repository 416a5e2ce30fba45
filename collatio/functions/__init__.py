"""Column functions: tokens and equality."""
