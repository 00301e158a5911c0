"""Rules of the board game in plain Python, and the column functions that need them."""
