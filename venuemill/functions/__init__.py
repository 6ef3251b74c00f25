"""Column functions: everything here takes Columns and returns a Column."""
