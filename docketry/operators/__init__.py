"""DataFrame operators: rollups, calendars, matching, retrieval, text and corpus jobs."""
