"""Named queries over the shared test tables, and independent SQL for each."""
