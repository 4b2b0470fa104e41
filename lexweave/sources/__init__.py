"""Reading landed records and tables; writing results."""
