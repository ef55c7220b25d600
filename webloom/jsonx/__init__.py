"""JSON paths, extraction and schema inference."""
