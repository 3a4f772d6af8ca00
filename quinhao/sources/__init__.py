"""Where the tables come from: files, a JDBC database, or a star schema."""
