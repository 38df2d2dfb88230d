"""Writing: topics, time-partitioned objects, log files, date shards, changelogs."""
