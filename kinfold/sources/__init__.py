"""Reading records and truth, writing results."""
