"""Tables in and out: readers, writers, profiles, snapshot changes, JSON records."""
