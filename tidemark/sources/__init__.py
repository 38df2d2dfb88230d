"""Reading: topics, tables, polls, shards, change capture, files, generated rows."""
