"""The two jobs a user runs: the model refresh and the live monitor."""
