"""Scripts as a stream of files."""
