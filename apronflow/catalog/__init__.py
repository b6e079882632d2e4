"""Named queries over the supplied tables, with the SQL that must give the same result."""
