"""Records in and out."""
