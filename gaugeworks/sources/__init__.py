"""Where rows come from: JSON messages, stored tables, and the mapping from the events table."""
