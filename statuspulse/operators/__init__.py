"""DataFrame-to-DataFrame operators.  None collects, none reads the wall clock."""
