"""Where the tables come from."""
