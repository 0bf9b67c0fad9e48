"""Column functions: text, URLs, identity, terms, venue."""
