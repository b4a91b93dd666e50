"""Following a folder of sources."""
