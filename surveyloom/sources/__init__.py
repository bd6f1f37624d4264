"""Reading datasets of tables and writing result tables."""
