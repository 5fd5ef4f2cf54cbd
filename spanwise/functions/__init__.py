"""Column functions: predicates, dates, exact money and arithmetic modulo a prime."""
