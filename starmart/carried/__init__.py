"""State that is carried from load to load, so that a load reads new sales only."""
