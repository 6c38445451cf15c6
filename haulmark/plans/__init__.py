"""Named pipelines."""
