"""Reading files, lists and tables that searches start from."""
