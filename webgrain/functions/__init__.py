"""Column functions: URLs, text, contacts, colours, status and time."""
