"""Reading files, agreeing on column names, and writing result tables."""
