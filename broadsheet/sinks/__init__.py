"""Writers: tables, files and models."""
