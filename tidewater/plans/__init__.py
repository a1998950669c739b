"""Named pipelines, test views, registered queries and their SQL."""
