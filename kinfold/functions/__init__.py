"""Column functions: normal forms of names and addresses, similarities, romanisation."""
