"""Reading and writing documents, logs and backups."""
