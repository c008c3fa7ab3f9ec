"""Sessions and whole query plans."""
